"""Frozen copies and the runs made from them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_case
from ..schemas import ASSIGNMENT


def _run_id(*parts) -> Column:
    return F.sha2(F.concat_ws("/", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts]), 256)


def freeze(tests: DataFrame, assignments: DataFrame) -> DataFrame:
    """Tests with their checks as an array in label order."""
    check = F.struct(fold_case(F.col("label")).alias("k"), "name", "label", F.map_entries("config").alias("config"), "answer_path")
    packed = assignments.groupBy("test_id").agg(F.array_sort(F.collect_list(check)).alias("_c"))
    restored = F.transform("_c", lambda c: F.struct(c["name"].alias("name"), c["label"].alias("label"),
                                                    F.map_from_entries(c["config"]).alias("config"), c["answer_path"].alias("answer_path")))
    return tests.join(packed, "test_id", "left").withColumn(
        "assignments", F.coalesce(restored, F.array().cast(f"array<{ASSIGNMENT}>"))).drop("_c")


def snapshot_into_set(chosen: DataFrame, frozen: DataFrame, entries: DataFrame, set_id) -> tuple[DataFrame, DataFrame]:
    """(new entries, tests the set already holds): one copy per chosen test."""
    ids = chosen.select("test_id").distinct()
    held = entries.filter(F.col("test_set_id").eqNullSafe(F.lit(set_id))).select("test_id")
    new = frozen.join(ids, "test_id", "left_semi").join(held, "test_id", "left_anti").withColumn("test_set_id", F.lit(set_id))
    return new.withColumn("entry_id", _run_id(F.lit("entry"), F.col("test_set_id").cast("string"), F.col("test_id").cast("string"))), \
        ids.join(held, "test_id", "left_semi")


def unlink_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries leave their set and stay as rows."""
    hit = ids.select("entry_id").distinct().withColumn("_out", F.lit(True))
    return entries.join(hit, "entry_id", "left").withColumn(
        "test_set_id", F.when(F.col("_out"), None).otherwise(F.col("test_set_id"))).drop("_out")


def _comparable(assignments: Column) -> Column:
    """Checks in label order with their settings sorted, fit for comparing."""
    return F.array_sort(F.transform(assignments, lambda a: F.struct(
        fold_case(a["label"]).alias("k"), a["label"].alias("label"), a["name"].alias("name"),
        F.array_sort(F.map_entries(F.coalesce(a["config"], F.create_map().cast("map<string,string>")))).alias("config"),
        a["answer_path"].alias("path"))))


CONTENT = ("input", "expected_output", "model_output")


def copy_matches(entries: DataFrame, tests: DataFrame) -> DataFrame:
    """Whether each entry still asks what its live test asks: input, expected
    and recorded answer, checks. The name does not count; null when the test
    is gone."""
    live = tests.select("test_id", *[F.col(c).alias(f"_{c}") for c in CONTENT], _comparable(F.col("assignments")).alias("_checks"),
                        F.lit(True).alias("_live"))
    same = _comparable(F.col("assignments")).eqNullSafe(F.col("_checks"))
    for c in CONTENT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return entries.join(live, "test_id", "left").withColumn("matches", F.when(F.col("_live"), same)).drop(
        "_live", "_checks", *[f"_{c}" for c in CONTENT])


def content_digest(assignments: str = "assignments", recorded: bool = False) -> Column:
    """One number for what an entry asks; the recorded answer may differ
    between batches that are compared."""
    parts = [F.col("input"), F.col("expected_output"), _comparable(F.col(assignments)).cast("string")]
    return F.xxhash64(*parts, *([F.col("model_output")] if recorded else []))


# ── fan-out ──────────────────────────────────────────────────────────────────

def _pending(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.lit("Pending"))


def fan_out_set(entries: DataFrame, set_id, execution_id: str) -> DataFrame:
    """One pending run per entry the set holds now."""
    mine = entries.filter(F.col("test_set_id") == F.lit(set_id))
    return _pending(mine.select(_run_id(F.lit(execution_id), F.col("entry_id").cast("string")).alias("run_id"), "entry_id",
                                F.lit(execution_id).alias("execution_id")))


def fan_out_sets(entries: DataFrame) -> DataFrame:
    """Every set at once: one execution per set."""
    execution = F.concat(F.lit("set-"), F.col("test_set_id").cast("string"))
    return _pending(entries.filter("test_set_id is not null").select(
        _run_id(execution, F.col("entry_id").cast("string")).alias("run_id"), "entry_id", execution.alias("execution_id")))


def fan_out_plan(links: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending runs of every plan over all its sets, linked sets that are empty)."""
    execution = F.concat(F.lit("plan-"), F.col("plan_id").cast("string"))
    runs = links.join(entries.select("entry_id", "test_set_id"), "test_set_id")
    runs = _pending(runs.select(_run_id(execution, F.col("entry_id").cast("string")).alias("run_id"), "entry_id", "plan_id", "test_set_id",
                                execution.alias("execution_id")))
    return runs, links.join(entries.select("test_set_id"), "test_set_id", "left_anti")


def replay(runs: DataFrame, executions: DataFrame) -> DataFrame:
    """The entries of past executions run again, whatever their sets hold now."""
    past = executions.select("execution_id")
    again = F.concat(F.lit("replay-"), F.col("execution_id").cast("string"))
    return _pending(runs.join(past, "execution_id", "left_semi").select(
        _run_id(again, F.col("entry_id").cast("string")).alias("run_id"), "entry_id", again.alias("execution_id"),
        F.col("execution_id").alias("replayed_execution_id")))


def fan_out_tests(frozen: DataFrame) -> DataFrame:
    """A frozen copy and a pending run per test, sharing the run's id."""
    return _pending(frozen.withColumn("run_id", _run_id(F.lit("standalone"), F.col("test_id").cast("string"))))


def fan_out_batch(entries: DataFrame, batch_id: str, first: int, last: int, leave_out: DataFrame | None = None) -> DataFrame:
    """Times first..last of every entry, with the labels each run skips. The
    first wave and later waves are the same work on other times."""
    rows = entries.select("entry_id")
    if leave_out is not None:
        skips = leave_out.groupBy("entry_id").agg(F.array_sort(F.collect_set("label")).alias("skip_labels"))
        rows = rows.join(skips, "entry_id", "left")
    else:
        rows = rows.withColumn("skip_labels", F.lit(None).cast("array<string>"))
    timed = rows.withColumn("batch_index", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return _pending(timed.select(_run_id(F.lit(batch_id), F.col("entry_id").cast("string"), F.col("batch_index").cast("string")).alias("run_id"),
                                 F.lit(batch_id).alias("batch_id"), "entry_id", "batch_index", "skip_labels"))


def fan_out_wave(runs: DataFrame, waves: DataFrame) -> DataFrame:
    """The next wave of open batches: the entries they already run, with the
    skips those runs had, at times first..last. `waves`: batch_id, first, last."""
    held = runs.groupBy("batch_id", "entry_id").agg(F.first("skip_labels", ignorenulls=True).alias("skip_labels"))
    timed = held.join(waves, "batch_id").withColumn("batch_index", F.explode(F.sequence("first", "last")))
    return _pending(timed.select(_run_id(F.col("batch_id").cast("string"), F.col("entry_id").cast("string"), F.col("batch_index").cast("string")).alias("run_id"),
                                 "batch_id", "entry_id", "batch_index", "skip_labels"))


def asked_checks(runs: DataFrame) -> DataFrame:
    """Each check a run asks: its frozen ones minus the labels it skips."""
    kept = F.filter("assignments", lambda a: ~F.coalesce(F.array_contains("skip_labels", a["label"]), F.lit(False)))
    return runs.withColumn("_a", F.explode(kept)).select(
        *[c for c in runs.columns if c not in ("assignments", "skip_labels")], F.col("_a.label").alias("label"), F.col("_a.name").alias("test_type"),
        F.col("_a.config").alias("config"), F.col("_a.answer_path").alias("answer_path"))


def run_check_types(runs: DataFrame) -> DataFrame:
    """The distinct types each run asks, without a shuffle: a run is one row."""
    kept = F.filter("assignments", lambda a: ~F.coalesce(F.array_contains("skip_labels", a["label"]), F.lit(False)))
    return runs.select("run_id", F.explode(F.array_distinct(F.transform(kept, lambda a: a["name"]))).alias("test_type"))


def entries_without_checks(entries: DataFrame) -> DataFrame:
    return entries.filter(F.coalesce(F.size("assignments"), F.lit(0)) <= 0).select("entry_id", "name")


def holdings(entries: DataFrame, tests: DataFrame, sets: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets holding each test with their copy: has it run, does it still
    match; unlinked copies per test)."""
    ran = runs.select("entry_id").distinct().withColumn("_ran", F.lit(True))
    linked = copy_matches(entries.filter("test_set_id is not null"), tests).join(ran, "entry_id", "left").join(
        sets.select("test_set_id", F.col("name").alias("set_name")), "test_set_id")
    held = linked.select("test_id", "test_set_id", "set_name", "entry_id", F.coalesce("_ran", F.lit(False)).alias("has_runs"), "matches")
    loose = entries.filter("test_set_id is null").groupBy("test_id").agg(F.count(F.lit(1)).alias("unlinked_copies"))
    return held, loose
