"""Datasets and tests: appending, editing, naming, labelling, validating."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.jsonpath import path_is_readable
from ..functions.text import fold_case, name_from_prompt, number_of, recorded_answer
from ..schemas import ASSIGNMENT
from ..session import kept
from .keyed import number_within, numbered, slice_of

SLICE = 1 << 16


# ── dataset rows ─────────────────────────────────────────────────────────────

def append_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """New rows numbered after their dataset's highest; gaps stay gaps. `new`
    has dataset_id and `ord`, a whole number giving the order sent."""
    highest = rows.groupBy("dataset_id").agg(F.max("position").alias("_top"))
    placed = (number_within(new, ["dataset_id"], ["ord"], slice_of("ord", SLICE), "_n").join(highest, "dataset_id", "left")
              .withColumn("position", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int")).drop("_n", "_top", "ord"))
    return rows.unionByName(placed)


def replace_rows(rows: DataFrame, dataset_id, new: DataFrame) -> DataFrame:
    """One dataset's rows swapped for others, numbered from 1."""
    placed = (number_within(new.withColumn("dataset_id", F.lit(dataset_id).cast(rows.schema["dataset_id"].dataType)), ["dataset_id"], ["ord"],
                            slice_of("ord", SLICE), "_n")
              .withColumn("position", F.col("_n").cast("int")).drop("_n", "ord"))
    return rows.filter(~F.col("dataset_id").eqNullSafe(F.lit(dataset_id))).unionByName(placed)


def upsert_rows(rows: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with new content by id, ids no row has). Any unknown id refuses
    the whole change, so write the first only when the second is empty."""
    content = ["input", "expected_output", "model_output"]
    named = changes.withColumnsRenamed({c: f"_{c}" for c in content}).withColumn("_hit", F.lit(True))
    out = rows.join(named, "id", "left")
    for c in content:
        out = out.withColumn(c, F.when(F.col("_hit"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    return out.select(*rows.columns), changes.select("id").join(rows.select("id"), "id", "left_anti")


def delete_rows(rows: DataFrame, tests: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows left, tests with the link to a deleted row cleared)."""
    gone = ids.select("id").distinct()
    hit = gone.select(F.col("id").alias("dataset_row_id"), F.lit(True).alias("_gone"))
    cleared = tests.join(hit, "dataset_row_id", "left").withColumn(
        "dataset_row_id", F.when(F.col("_gone"), None).otherwise(F.col("dataset_row_id"))).select(*tests.columns)
    return rows.join(gone, "id", "left_anti"), cleared


def describe_datasets(datasets: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows counted and the prompt of the lowest-numbered one."""
    got = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.min_by("input", "position").alias("first_prompt"))
    return datasets.join(got, datasets["id"] == got["dataset_id"], "left").select(
        *[datasets[c] for c in datasets.columns], F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "first_prompt")


def describe_rows(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows with how many tests came from each."""
    made = tests.filter("dataset_row_id is not null").groupBy(F.col("dataset_row_id").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
    return rows.join(made, "id", "left").withColumn("tests", F.coalesce("tests", F.lit(0)).cast("long"))


# ── tests ────────────────────────────────────────────────────────────────────

def assignment_list(assignments: list[dict]) -> Column:
    """The checks one request gives to every test, as a constant array."""
    def text(v):
        return F.lit(v).cast("string")
    def config(c):
        pairs = [x for k, v in (c or {}).items() for x in (F.lit(k), text(v))]
        return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
    return F.array(*[F.struct(text(a["name"]).alias("name"), text(a["label"]).alias("label"), config(a.get("config")).alias("config"),
                              text(a.get("answer_path")).alias("answer_path")) for a in assignments]).cast(f"array<{ASSIGNMENT}>")


def tests_from_rows(rows: DataFrame, assignments: list[dict], naming: str = "prompt", leave_out_recorded: bool = False,
                    existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tests, their assignments) made from dataset rows: id is derived from
    the row, so making them twice makes the same tests."""
    made = rows.withColumn("test_id", F.sha2(F.concat_ws("/", F.lit("test"), F.col("id").cast("string")), 256))
    if naming == "prompt":
        made = made.withColumn("name", name_from_prompt(F.col("input")))
    else:
        made = number_names(existing, made, "id")
    answer = F.lit(None).cast("string") if leave_out_recorded else recorded_answer(F.col("model_output"))
    tests = made.select("test_id", F.col("id").alias("dataset_row_id"), "name", "input", "expected_output", answer.alias("model_output"))
    each = tests.select("test_id", F.explode(assignment_list(assignments)).alias("a")).select("test_id", "a.*")
    return tests, each


def foreign_rows(chosen: DataFrame, rows: DataFrame, dataset_id) -> DataFrame:
    """Chosen row ids the dataset does not have."""
    return chosen.select("id").join(rows.filter(F.col("dataset_id") == F.lit(dataset_id)).select("id"), "id", "left_anti")


def number_names(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Names 'New Test n', going on from the highest number any test has."""
    number = F.regexp_extract("name", "^New Test ([0-9]{1,18})$", 1).try_cast("long")
    highest = existing.agg(F.coalesce(F.max(number), F.lit(0)).alias("top")).scalar()
    placed = numbered(new, [F.col(order)], "_n")
    return placed.withColumn("name", F.concat(F.lit("New Test "), (highest + F.col("_n")).cast("string"))).drop("_n")


def label_key(label: Column) -> Column:
    return fold_case(label)


def label_assignments(assignments: DataFrame) -> DataFrame:
    """A label for every assignment sent without one: the type's name, then
    'name 2', 'name 3', ... skipping labels sent, letter case aside.

    Reads test_id, pos (order sent), name, label. The k-th free number is k
    plus how many taken numbers lie at or before it, got from one running
    count of taken numbers and rows together.
    """
    a = assignments.withColumn("_key", label_key(F.col("name")))
    sent = F.col("label").isNotNull() & (F.col("label") != "")
    folded = label_key(F.col("label"))
    whole = a.filter(sent).select("test_id", folded.alias("_key"), F.lit(1).cast("long").alias("_t"))
    numbered = a.filter(sent & F.col("label").rlike("^.+ [1-9][0-9]{0,8}$")).select(
        "test_id", F.regexp_extract(folded, "^(.+) [0-9]+$", 1).alias("_key"),
        F.regexp_extract(folded, " ([0-9]+)$", 1).cast("long").alias("_t")).filter("_t > 1")
    by_key = W.partitionBy("test_id", "_key")
    taken = whole.unionByName(numbered).distinct().withColumn("_v", F.col("_t") - F.row_number().over(by_key.orderBy("_t"))).select(
        "test_id", "_key", "_v", F.lit(0).alias("_row"), F.lit(None).cast(a.schema["pos"].dataType).alias("pos"))
    asking = a.filter(~F.coalesce(sent, F.lit(False))).withColumn("_k", F.row_number().over(by_key.orderBy("pos")).cast("long"))
    rows = asking.select("test_id", "_key", F.col("_k").alias("_v"), F.lit(1).alias("_row"), "pos")
    # taken with a value below k come first: rows sort after takens only when strictly greater
    ordered = by_key.orderBy("_v", F.desc("_row"), "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = taken.unionByName(rows).withColumn("_skip", F.sum(1 - F.col("_row")).over(ordered)).filter("_row = 1").select(
        "test_id", "pos", (F.col("_v") + F.col("_skip")).alias("_n"))
    out = a.join(placed, ["test_id", "pos"], "left")
    made = F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", F.col("_n").cast("string")))
    return out.withColumn("label", F.when(F.col("_n").isNull(), F.col("label")).otherwise(made)).drop("_key", "_n")


# ── validation ───────────────────────────────────────────────────────────────

def _number_problem(field: Column, value: Column) -> Column:
    n = number_of(value)
    low, high = field["min"], field["max"]
    out = (low.isNotNull() & (n < low)) | (high.isNotNull() & (n > high))
    return (F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), "not_a_number")
            .when(F.coalesce(field["whole"], F.lit(False)) & (n != F.floor(n)), "not_whole")
            .when(F.coalesce(out, F.lit(False)), "out_of_range"))


def validate_assignments(assignments: DataFrame, types: DataFrame) -> DataFrame:
    """Every problem of every assignment: unknown types, labels sent twice,
    required fields missing, numbers out of their field's rules. Rows of
    (test_id, label, name, problem)."""
    joined = assignments.join(types.select(F.col("name"), "config_fields"), "name", "left")
    unknown = joined.filter("config_fields is null").select("test_id", "label", "name", F.lit("unknown_type").alias("problem"))
    fields = joined.filter("config_fields is not null").select("test_id", "label", "name", "config", F.explode("config_fields").alias("f")).filter(
        "f.kind <> 'reference'")
    value = F.col("config")[F.col("f.key")]
    empty = value.isNull() | (value == "")
    reason = F.when(empty, F.when(F.col("f.required"), "missing")).when(F.col("f.kind") == "numeric", _number_problem(F.col("f"), value))
    wrong = fields.withColumn("_r", reason).filter("_r is not null").select(
        "test_id", "label", "name", F.concat_ws(":", "f.key", "_r").alias("problem"))
    twice = (assignments.filter("label is not null and label <> ''").groupBy("test_id", label_key(F.col("label")).alias("label"))
             .agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
             .select("test_id", "label", F.lit(None).cast("string").alias("name"), F.lit("duplicate_label").alias("problem")))
    return unknown.unionByName(wrong).unionByName(twice)


def validate_values(values: DataFrame) -> DataFrame:
    """Problem of each distinct (kind, value), null when fine. JSON and paths
    are read in the JVM; patterns and schema texts, few as they are, are tried
    once each in Python."""
    def tried(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        for part in parts:
            found = []
            for kind, value in zip(part["kind"], part["value"]):
                problem = None
                if kind == "regex":
                    try:
                        regex.compile(value)
                    except regex.error:
                        problem = "invalid_pattern"
                elif kind == "json_schema":
                    try:
                        if not isinstance(json.loads(value), (dict, bool)):
                            problem = "not_object_or_boolean"
                    except json.JSONDecodeError:
                        problem = "not_json"
                found.append(problem)
            yield part.assign(problem=found)

    # as a table: either half below would find the distinct values again
    distinct = kept(values.select("kind", "value").distinct(), "values")
    in_python = F.col("kind").isin("regex", "json_schema")
    native = distinct.filter(~in_python).withColumn("problem", F.when(
        (F.col("kind") == "json") & F.try_parse_json("value").isNull(), "not_json").when(
        (F.col("kind") == "jsonpath") & ~path_is_readable(F.col("value")), "invalid_path"))
    return native.unionByName(distinct.filter(in_python).mapInPandas(tried, "kind string, value string, problem string"))


def needs_reference(fields: Column) -> Column:
    return F.exists(fields, lambda f: (f["kind"] == "reference") & f["required"])


def missing_reference(tests: DataFrame, assignments: DataFrame, types: DataFrame) -> DataFrame:
    """Tests without an expected output under a type that needs one."""
    needing = types.filter(needs_reference(F.col("config_fields"))).select("name")
    bare = tests.filter(F.coalesce(F.col("expected_output") == "", F.lit(True))).select("test_id")
    return assignments.join(needing, "name", "left_semi").join(bare, "test_id").select("test_id", "name").distinct()


def patch_tests(tests: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial edits: fields in `sent` are written. A null clears only the
    expected or recorded answer; a null name, input or check list changes
    nothing; a check list is replaced whole."""
    edits = patches.withColumnsRenamed({c: f"_{c}" for c in patches.columns if c != "test_id"})
    out = tests.join(edits, "test_id", "left")
    for field in ("name", "input", "assignments"):
        if f"_{field}" in out.columns:
            out = out.withColumn(field, F.when(F.array_contains("_sent", field), F.coalesce(f"_{field}", field)).otherwise(F.col(field)))
    for field in ("expected_output", "model_output"):
        if f"_{field}" in out.columns:
            out = out.withColumn(field, F.when(F.array_contains("_sent", field), F.col(f"_{field}")).otherwise(F.col(field)))
    return out.select(*tests.columns)


def deletable(tests: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """What stands in the way of deleting each test: held by a set, has runs."""
    held = entries.filter("test_set_id is not null").select("test_id").distinct().withColumn("held", F.lit(True))
    ran = runs.filter("test_id is not null").select("test_id").distinct().withColumn("has_runs", F.lit(True))
    return tests.select("test_id").join(held, "test_id", "left").join(ran, "test_id", "left").na.fill(False, ["held", "has_runs"])


def has_runs(keys: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Which of the given sets, entries or plans have runs."""
    ran = runs.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("has_runs", F.lit(True))
    return keys.select(key).join(ran, key, "left").na.fill(False, ["has_runs"])


def coverage(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows of each dataset that a test was made from."""
    made = describe_rows(rows, tests)
    return made.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("tests") > 0).alias("covered"))

