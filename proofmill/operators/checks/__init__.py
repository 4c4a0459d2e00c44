"""Scoring operators. Each takes rows of

    run_id, label, answer, reference, config, engine_settings, comparison

and adds `passed`, `score`, `detail`, `errored`. A check that cannot be
evaluated is not passed and errored, with the reason; it never stops others.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import number_of, strip

RESULT = ("passed", "score", "detail", "errored")


def setting(name: str, default: bool) -> Column:
    """A yes/no setting of the catalogue row."""
    raw = F.col("engine_settings")[name]
    return F.coalesce(F.lower(raw) == "true", F.lit(default))


def option(name: str, default: str) -> Column:
    return F.coalesce(F.col("engine_settings")[name], F.lit(default))


def outcome(df: DataFrame, error: Column, passed: Column, miss: Column, score: Column | None = None) -> DataFrame:
    """Writes the four result columns from an error text (null when fine), a
    pass condition and the detail of a miss."""
    # staged first, so each is worked out once however often it is read below
    staged = df.withColumns({"_error": error, "_passed": passed, "_miss": miss,
                             "_score": score if score is not None else F.lit(None).cast("double")})
    failed, met = F.col("_error").isNotNull(), F.coalesce(F.col("_passed"), F.lit(False))
    return staged.withColumns({
        "passed": ~failed & met, "score": F.when(~failed, F.col("_score")).cast("double"),
        "detail": F.when(failed, F.col("_error")).when(~met, F.col("_miss")).cast("string"),
        "errored": failed}).drop("_error", "_passed", "_miss", "_score")


def threshold_columns(score: Column) -> tuple[Column, Column, Column]:
    """(error, passed, miss) of a four-decimal score against its threshold, in
    the direction the catalogue row declares; equality passes."""
    raw = F.col("config")["threshold"]
    number = number_of(raw)
    error = (F.when(F.col("reference").isNull(), "no_reference")
             .when(raw.isNull() | (strip(raw) == ""), "no_threshold").when(number.isNull(), "threshold_not_number")
             .when(F.col("comparison").isNull() | ~F.col("comparison").isin("gte", "lte"), "no_comparison"))
    # NaN compares false either way; Spark alone would order it above all numbers
    passed = ~F.isnan(number) & F.when(F.col("comparison") == "gte", score >= number).otherwise(score <= number)
    miss = F.when(F.col("comparison") == "gte", "below_threshold").otherwise("above_threshold")
    return error, passed, miss


def against_threshold(df: DataFrame, score: str = "raw_score") -> DataFrame:
    """Turns a raw score column into a result."""
    kept = F.round(F.col(score), 4)
    error, passed, miss = threshold_columns(kept)
    return outcome(df, error, passed, miss, kept).drop(score)
