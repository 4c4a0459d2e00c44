"""Evaluation rows from JSON lines: read, number, validate, report."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonpath import kind_of
from ..functions.text import strip
from ..operators.keyed import number_within

FIELDS = ("prompt", "expected_output", "model_output")


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of every non-blank line. Lines end at \\n, \\r\\n or a
    lone \\r, are numbered from 1 per file with blank ones counted, and files
    stay splittable: lines are numbered inside their split and shifted by the
    line counts of the splits before it."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    # only the order inside one split is read from this id
    placed = raw.withColumn("_at", F.monotonically_increasing_id())
    numbered = number_within(placed, ["file"], ["_at"], F.col("_block"), "line")
    text = F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return numbered.select("file", "line", text.alias("value")).filter(strip(F.col("value")) != "")


def validate_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with every problem): valid JSON, an object, three
    text fields."""
    doc = F.try_parse_json("value")
    typed = lines.withColumn("_doc", doc).withColumn("_kind", kind_of(F.col("_doc")))
    part = lambda f: F.try_variant_get("_doc", F.lit(f"$.{f}"), "variant")
    problems = F.when(F.col("_doc").isNull(), F.array(F.lit("not_json"))).when(
        F.col("_kind") != "object", F.array(F.lit("not_an_object"))).otherwise(F.array_compact(F.array(*[
            F.when(part(f).isNull(), F.lit(f"{f}:missing")).when(kind_of(part(f)) != "string", F.lit(f"{f}:not_text"))
            for f in FIELDS])))
    checked = typed.withColumn("problems", problems)
    keep = [c for c in lines.columns if c != "value"]
    good = checked.filter(F.size("problems") == 0).select(
        *keep, F.try_variant_get("_doc", F.lit("$.prompt"), "string").alias("input"),
        *[F.try_variant_get("_doc", F.lit(f"$.{f}"), "string").alias(f) for f in FIELDS[1:]])
    bad = checked.filter(F.size("problems") > 0).select(*keep, "problems")
    return good, bad


def import_report(bad: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """How many lines are invalid (any at all refuses the import), and the
    first of them by line."""
    count = bad.agg(F.count(F.lit(1)).alias("invalid_lines")).withColumn("accepted", F.col("invalid_lines") == 0)
    order = [c for c in ("file", "line") if c in bad.columns]
    return count, bad.orderBy(*order).limit(limit)
