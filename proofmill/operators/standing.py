"""How things stand: newest runs, counts by status, outcomes of executions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import IN_FLIGHT_STATUSES, RUN_STATUSES
from .keyed import count_by, latest_per

SEVERITY = ("NotRan", "Red", "Amber", "Green")


def run_counts_by(runs: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Runs by status per key; all six statuses are always there."""
    got = runs.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in RUN_STATUSES])
    if keys is None:
        return got
    return keys.select(key).distinct().join(got, key, "left").select(
        key, *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in RUN_STATUSES])


def outcome_of(prefix: str = "") -> Column:
    """One word for an execution from its counts: Running while any run is in
    flight, else the worst status present; null with no runs."""
    c = lambda s: F.coalesce(F.col(prefix + s), F.lit(0)) > 0
    out = F.when(c(IN_FLIGHT_STATUSES[0]) | c(IN_FLIGHT_STATUSES[1]), "Running")
    for s in SEVERITY:
        out = out.when(c(s), s)
    return out


def execution_outcome(runs: DataFrame, key: str = "execution_id") -> DataFrame:
    return run_counts_by(runs, key).select(key, outcome_of().alias("outcome"))


def latest_batches(batches: DataFrame, key: str = "scope_id") -> DataFrame:
    return latest_per(batches, key, [F.desc("created_at"), F.desc("batch_id")])


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each test that is neither in a batch nor of a scope."""
    alone = runs.filter(F.col("test_id").isNotNull() & F.col("batch_id").isNull())
    return latest_per(alone, "test_id", [F.desc("created_at"), F.desc("run_id")])


def scope_standing(scopes: DataFrame, executions: DataFrame, runs: DataFrame, batches: DataFrame) -> DataFrame:
    """Per scope (set or plan): executions outside batches, the latest with its
    counts and outcome, the latest batch, and whether anything ran. Inputs
    carry scope_id; `executions` the executions of this kind of scope."""
    own = executions.filter(F.col("batch_id").isNull())
    last = latest_per(own, "scope_id", [F.desc("created_at"), F.desc("execution_id")]).select(
        "scope_id", F.col("execution_id").alias("last_execution"), F.col("created_at").alias("last_at"))
    # only the last execution's runs are counted
    counts = run_counts_by(runs.join(last.select(F.col("last_execution").alias("execution_id")), "execution_id", "left_semi"),
                           "execution_id")
    counted = count_by(own, "scope_id", scopes.select(F.col("id").alias("scope_id")), "executions")
    batch = latest_batches(batches).select("scope_id", F.col("batch_id").alias("last_batch"), F.col("status").alias("last_verdict"),
                                           F.col("created_at").alias("batch_at"))
    ran = executions.select("scope_id").distinct().withColumn("has_runs", F.lit(True))
    return (scopes.withColumn("scope_id", F.col("id")).join(counted, "scope_id").join(last, "scope_id", "left")
            .join(counts, F.col("last_execution") == counts["execution_id"], "left").drop("execution_id")
            .join(batch, "scope_id", "left").join(ran, "scope_id", "left")
            .withColumn("has_runs", F.coalesce("has_runs", F.lit(False)))
            .withColumn("last_outcome", F.when(F.col("last_execution").isNotNull(), outcome_of())))


def test_standing(tests: DataFrame, runs: DataFrame, batches: DataFrame, copies: DataFrame) -> DataFrame:
    """Per test: latest run and batch, whether it ran, how many copies sets
    hold and in how many sets. `copies`: test_id, test_set_id (null once
    unlinked)."""
    run = latest_runs(runs).select("test_id", F.col("run_id").alias("last_run"), F.col("status").alias("last_status"),
                                   F.col("created_at").alias("run_at"))
    batch = latest_batches(batches).select(F.col("scope_id").alias("test_id"), F.col("batch_id").alias("last_batch"),
                                           F.col("status").alias("last_verdict"), F.col("created_at").alias("batch_at"))
    ran = runs.filter("test_id is not null").select("test_id").distinct().withColumn("has_runs", F.lit(True))
    held = copies.groupBy("test_id", "test_set_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("test_id").agg(
        F.sum("_n").alias("copies"), F.count("test_set_id").alias("sets"))
    return (tests.withColumn("test_id", F.col("id")).join(run, "test_id", "left").join(batch, "test_id", "left")
            .join(ran, "test_id", "left").join(held, "test_id", "left")
            .withColumn("has_runs", F.coalesce("has_runs", F.lit(False)))
            .withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long"))
            .withColumn("sets", F.coalesce("sets", F.lit(0)).cast("long")))


def activity() -> Column:
    """When a test was last touched by a run or batch, else created."""
    return F.coalesce(F.greatest("run_at", "batch_at"), F.col("created_at"))


def describe_sets(sets: DataFrame, entries: DataFrame, links: DataFrame) -> DataFrame:
    """Sets with entries counted and plans linking them."""
    ids = sets.select(F.col("id").alias("test_set_id"))
    return (sets.withColumn("test_set_id", F.col("id"))
            .join(count_by(entries, "test_set_id", ids, "entries"), "test_set_id")
            .join(count_by(links, "test_set_id", ids, "plans"), "test_set_id").drop("test_set_id"))


def describe_plans(plans: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Plans with sets linked and entries reached."""
    sizes = entries.groupBy("test_set_id").agg(F.count(F.lit(1)).alias("_n"))
    got = links.join(sizes, "test_set_id", "left").groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("_n"), F.lit(0)).alias("entries"))
    return plans.join(got, plans["id"] == got["plan_id"], "left").select(
        *plans.columns, F.coalesce("sets", F.lit(0)).cast("long").alias("sets"),
        F.coalesce("entries", F.lit(0)).cast("long").alias("entries"))


# ── executions ───────────────────────────────────────────────────────────────

def list_executions(executions: DataFrame, runs: DataFrame) -> DataFrame:
    """Executions with their runs counted by status; those without runs stay."""
    counts = run_counts_by(runs, "execution_id")
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in RUN_STATUSES), F.lit(0))
    return executions.join(counts, "execution_id", "left").select(
        *executions.columns, *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in RUN_STATUSES],
        total.alias("runs"), outcome_of().alias("outcome"))


def newest_executions(set_executions: DataFrame, plan_executions: DataFrame, runs: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page over both kinds, newest first. The page is cut before runs are
    counted, so only its executions' runs are read into the count."""
    page = (set_executions.unionByName(plan_executions).orderBy(F.desc("created_at"), F.desc("execution_id"))
            .offset(offset).limit(limit))
    return list_executions(page, runs.join(page.select("execution_id"), "execution_id", "left_semi"))


def status_rank() -> Column:
    """What needs looking at first, then what met every check, then what is
    still under way."""
    # Fixed values
    order = {"NotRan": 0, "Red": 1, "Amber": 2, "Green": 3, "Running": 4, "Pending": 5}
    return F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for s, i in order.items()])


def execution_runs(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Runs with the name of what they ran and the rank `worst first` sorts by."""
    return runs.join(names, "scope_id", "left").withColumn("rank", status_rank())


def execution_checks(results: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """Per execution: checks met, every unmet one, every run that did not run
    with the checks it would have asked, as rows of one table.

    kind is met (one row, `count`), unmet (run_id, label) or not_ran (run_id,
    `count` of checks): a table rather than arrays, so a huge execution stays
    many rows.
    """
    ok = F.col("passed") & ~F.col("errored")
    none = lambda t: F.lit(None).cast(t)
    met = results.groupBy(*key).agg(F.count_if(ok).alias("count")).select(
        *key, F.lit("met").alias("kind"), none("string").alias("run_id"), none("string").alias("label"), "count")
    unmet = results.filter(~ok).select(*key, F.lit("unmet").alias("kind"), "run_id", "label", none("long").alias("count"))
    idle = runs.filter("status = 'NotRan'").select(*key, F.lit("not_ran").alias("kind"), "run_id", none("string").alias("label"),
                                                   F.size("asked").cast("long").alias("count"))
    return met.unionByName(unmet).unionByName(idle)


def run_details(runs: DataFrame, copies: DataFrame, executions: DataFrame) -> DataFrame:
    """Runs with the frozen copy they scored and their execution."""
    e = executions.select("execution_id", F.col("origin").alias("execution_origin"), F.col("created_at").alias("execution_at"))
    return runs.join(copies, "entry_id", "left").join(e, "execution_id", "left")
