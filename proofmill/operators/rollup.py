"""From check results to run outcomes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roll_up_runs(results: DataFrame, runs: DataFrame | None = None, key: str = "run_id") -> DataFrame:
    """Green when every check passed, Red when none did, Amber between. An
    errored check counts as not passed; a run left with no check is Green, so
    give `runs` to keep those."""
    ok = F.coalesce(F.col("passed"), F.lit(False)) & ~F.coalesce(F.col("errored"), F.lit(False))
    out = results.groupBy(key).agg(F.bool_and(ok).alias("_all"), F.bool_or(ok).alias("_any"))
    if runs is not None:
        out = runs.select(key).join(out, key, "left")
    return out.select(key, F.when(F.coalesce("_all", F.lit(True)), "Green").when(F.col("_any"), "Amber")
                      .otherwise("Red").alias("status"))


def count_checks(results: DataFrame, key: str = "run_id") -> DataFrame:
    """Checks met, checks in all, and the labels not met, in label order."""
    return results.groupBy(key).agg(
        F.count_if(F.col("passed") & ~F.col("errored")).alias("met"), F.count(F.lit(1)).alias("total"),
        F.array_sort(F.collect_list(F.when(~(F.col("passed") & ~F.col("errored")), F.struct(
            F.lower("label").alias("k"), F.col("label").alias("label"))))).alias("_unmet")
    ).select(key, "met", "total", F.transform("_unmet", lambda u: u["label"]).alias("unmet"))


def run_passed(results: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each run passed, over its decided checks; null when it decided
    nothing."""
    return results.groupBy(*keys).agg(
        F.bool_and(F.when(~F.col("errored"), F.col("passed"))).alias("run_passed"))
