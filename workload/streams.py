"""Streams over events read as run events, and lineitem results as they come."""
from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from proofmill.operators.checks import outcome
from proofmill.operators.checks.dispatch import register_engine, registered_engines, score_checks
from proofmill.operators.sequential import even_level, looks
from proofmill.session import kept, shared_folder
from proofmill.sources.catalogue import check_types
from proofmill.streaming import runs as R

from . import world
from .batches import t_tail_sql
from .registry import query, view

STATUS = "CASE event_type WHEN 'purchase' THEN 'Green' WHEN 'click' THEN 'Amber' WHEN 'view' THEN 'Red' WHEN 'error' THEN 'NotRan' ELSE 'Pending' END"
view("revents", f"SELECT event_id, user_id AS run_id, ts, {STATUS} AS status, props, 'b' || (user_id // 10) AS batch_id FROM events")


def _events(spark, sf):
    schema = world.table(spark, sf, "events").schema
    e = R.read_events(spark, sf, schema, "events.parquet")
    return e.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(STATUS).alias("status"),
                    F.concat(F.lit("b"), F.floor(F.col("user_id") / 10).cast("string")).alias("batch_id"))


STATES = "run_id long, batch_id string, status string, ts timestamp"


@query("live_run_state", "SELECT run_id, status FROM revents QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1", ["revents"])
def live_run_state(spark, sf):
    """The last state of each run once the stream has read everything."""
    folder, _ = R.to_table(R.stream_run_state(_events(spark, sf), "60 days"), "update", "state")
    return R.newest_rows(spark, folder, ["run_id"], STATES).select("run_id", "status")


@query("claimed_events", "SELECT run_id, status FROM revents GROUP BY 1, 2", ["revents"])
def claimed_events(spark, sf):
    """Every (run, status) delivered once within the watermark."""
    folder, _ = R.to_table(R.claim_once(_events(spark, sf).unionByName(_events(spark, sf)), "60 days"), "append", "claims")
    return spark.read.schema("run_id long, status string").parquet(folder).select("run_id", "status")


_SC = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("Pending", "Running", "Green", "Amber", "Red", "NotRan"))


@query("live_progress", f"""SELECT batch_id, count(*) AS runs, {_SC} FROM (SELECT * FROM revents
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1""", ["revents"])
def live_progress(spark, sf):
    """Progress of each batch by what its runs are now."""
    folder, _ = R.to_table(R.stream_run_state(_events(spark, sf), "60 days"), "update", "progress")
    return R.progress(R.newest_rows(spark, folder, ["run_id"], STATES))


@query("windowed_outcomes", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, status, count(*) AS runs FROM revents GROUP BY 1, 2", ["revents"])
def windowed_outcomes(spark, sf):
    folder, _ = R.to_table(R.windowed_outcomes(_events(spark, sf), "1 hour", late="60 days"), "update", "windows")
    rows = R.newest_rows(spark, folder, ["start", "status"], "start timestamp, status string, runs long")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "status", "runs")


@query("sliding_outcomes", """SELECT strftime(w, '%Y-%m-%d %H') AS start, status, count(*) AS runs
FROM (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * CAST((hour(ts) % 6) + 6 * k AS INTEGER) AS w, status FROM revents, (VALUES (0), (1)) t(k)) GROUP BY 1, 2""", ["revents"])
def sliding_outcomes(spark, sf):
    folder, _ = R.to_table(R.windowed_outcomes(_events(spark, sf), "12 hours", "6 hours", late="60 days"), "update", "slides")
    rows = R.newest_rows(spark, folder, ["start", "status"], "start timestamp, status string, runs long")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "status", "runs")


NOW = datetime(2024, 1, 15)


@query("stale_pending_runs", "SELECT event_id, run_id FROM revents WHERE status = 'Pending' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTE", ["revents"])
def stale_pending_runs(spark, sf):
    e = world.table(spark, sf, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("created_at"), F.expr(STATUS).alias("status"))
    return R.stale_pending(e, NOW).select("event_id", "run_id")


@query("stale_pending_stream", """SELECT event_id AS run_id FROM revents WHERE status = 'Pending'
  AND epoch_ms(ts) + 15 * 60000 <= (SELECT max(epoch_ms(ts)) FROM revents) - 3600000""", ["revents"])
def stale_pending_stream(spark, sf):
    """Each event is its own run here; those pending at the end of the stream
    for longer than the threshold come out, up to the watermark."""
    e = _events(spark, sf).withColumn("run_id", F.col("event_id"))
    folder, _ = R.to_table(R.stream_stale_pending(e), "append", "stale")
    return spark.read.schema("run_id long, pending_since timestamp").parquet(folder).select("run_id")


def _streamed_sql(counted: str) -> str:
    return f"""
WITH r AS (SELECT *, batch_id || '-' || entry_id || '-' || label AS b FROM results),
x AS (SELECT b, entry_id, label, 10 AS f, m, least(8, m - 9) AS c FROM (SELECT b, entry_id, label, max(batch_index) AS m FROM r GROUP BY ALL)),
p AS (SELECT DISTINCT b, m, CASE WHEN m <= f THEN f ELSE f + CAST(round_even((m - f)::DOUBLE / (c - 1) * i, 0) AS BIGINT) END AS look FROM x, generate_series(0, 7) g(i) WHERE i < greatest(c, 1)
  UNION SELECT b, m, greatest(m, f) FROM x),
lv AS (SELECT *, 0.05 / count(*) OVER (PARTITION BY b) AS alpha FROM p),
a AS (SELECT b, entry_id, label, look, alpha, count(*) FILTER (WHERE NOT errored) AS evaluated, count(*) FILTER (WHERE NOT errored AND passed) AS passes
  FROM r JOIN lv USING (b) WHERE m >= 10 AND batch_index <= look GROUP BY ALL),
k AS (SELECT *, {counted} AS k FROM a),
v AS (SELECT *, CASE WHEN evaluated = 0 THEN NULL WHEN {world.binomial_sql('at_least', 'k', 'evaluated', '0.9')} <= alpha THEN 'pass'
  WHEN {world.binomial_sql('at_most', 'k', 'evaluated', '0.9')} <= alpha THEN 'fail' END AS verdict FROM k)
SELECT b AS batch_id, entry_id, label, verdict, CAST(CASE WHEN verdict IS NOT NULL THEN look END AS INTEGER) AS at_time, CAST(k AS INTEGER) AS passes, CAST(evaluated AS INTEGER) AS evaluated
FROM v QUALIFY row_number() OVER (PARTITION BY b ORDER BY verdict IS NULL, CASE WHEN verdict IS NULL THEN -look ELSE look END) = 1"""


# how many files the results come in: a micro-batch costs seconds whatever it
# brings, so it brings a share of all results rather than a file of fixed size
RESULT_FILES = 12


def _streamed(spark, sf, agreement=False, means=False):
    """Every check is a batch of its own with looks from its tenth time to its
    last; all results come twice."""
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    rows = world.timed_results(spark, sf).withColumn("batch_index", F.col("batch_index").cast("int")).withColumn("batch_id", F.concat_ws("-", "batch_id", "entry_id", "label"))
    value = "score double" if means else "passed boolean"
    names = ["batch_id", "entry_id", "label", "batch_index"]  # every file holds results of all checks
    rows.select(*names, value.split()[0], "errored").repartition(RESULT_FILES, *names).write.parquet(folder)
    kind = f"batch_id string, entry_id long, label string, batch_index int, {value}, errored boolean"
    plans = spark.read.schema(kind).parquet(folder).groupBy("batch_id").agg(F.max("batch_index").alias("m")).withColumn("looks", looks(F.lit(10), F.col("m")))
    plans = plans.select("batch_id", "looks", even_level(F.col("looks"), 0.95).alias("level"), F.lit(0.9).alias("target"))
    once = spark.readStream.schema(kind).option("maxFilesPerTrigger", 3).parquet(folder)
    again = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(folder)
    both = once.unionByName(again)
    if means:
        plans = kept(plans.drop("target").withColumns({"threshold": F.lit(0.45), "higher_passes": F.lit(True)}), "plans")
        out, _ = R.to_table(R.stream_sequential_means(both, plans), "append", "means")
        return spark.read.schema(R.MEAN_DECISIONS).parquet(out).drop("epoch", "error")
    out, _ = R.to_table(R.stream_sequential(both, kept(plans, "plans"), agreement), "append", "decisions")
    return spark.read.schema(R.DECISIONS).parquet(out).drop("epoch", "error")


@query("streamed_decisions", _streamed_sql("passes"), ["results"])
def streamed_decisions(spark, sf):
    """Wave decisions from a stream of result files, each made once."""
    return _streamed(spark, sf)


@query("streamed_agreement", _streamed_sql("greatest(passes, evaluated - passes)"), ["results"])
def streamed_agreement(spark, sf):
    """The same for how often runs agree with the usual verdict."""
    return _streamed(spark, sf, agreement=True)


@query("streamed_means", f"""
WITH r AS (SELECT *, batch_id || '-' || entry_id || '-' || label AS b FROM results),
x AS (SELECT b, entry_id, label, 10 AS f, m, least(8, m - 9) AS c FROM (SELECT b, entry_id, label, max(batch_index) AS m FROM r GROUP BY ALL)),
p AS (SELECT DISTINCT b, m, CASE WHEN m <= f THEN f ELSE f + CAST(round_even((m - f)::DOUBLE / (c - 1) * i, 0) AS BIGINT) END AS look FROM x, generate_series(0, 7) g(i) WHERE i < greatest(c, 1)
  UNION SELECT b, m, greatest(m, f) FROM x),
lv AS (SELECT *, 1 - 0.05 / count(*) OVER (PARTITION BY b) AS level FROM p),
a AS (SELECT b, entry_id, label, look, level, count(score) FILTER (WHERE NOT errored) AS n, avg(score) FILTER (WHERE NOT errored) AS mean, stddev_samp(score) FILTER (WHERE NOT errored) AS sd,
  min(score) FILTER (WHERE NOT errored) AS lo, max(score) FILTER (WHERE NOT errored) AS hi FROM r JOIN lv USING (b) WHERE m >= 10 AND batch_index <= look GROUP BY ALL),
t AS (SELECT *, (mean - 0.45) / (sd / sqrt(n)) AS t FROM a),
w AS (SELECT *, CASE WHEN n >= 2 AND lo < hi THEN {t_tail_sql('t', '(n - 1)')} END AS pp FROM t),
v AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN lo = hi THEN CASE WHEN lo >= 0.45 THEN 'pass' ELSE 'fail' END WHEN pp <= 1 - level THEN 'pass' WHEN 1 - pp <= 1 - level THEN 'fail' END AS verdict FROM w)
SELECT b AS batch_id, entry_id, label, verdict, CAST(CASE WHEN verdict IS NOT NULL THEN look END AS INTEGER) AS at_time, CAST(n AS INTEGER) AS n,
  CASE WHEN n >= 2 THEN round(mean, 8) END AS mean, CASE WHEN n >= 2 THEN round(coalesce(sd, 0), 4) END AS sd
FROM v QUALIFY row_number() OVER (PARTITION BY b ORDER BY verdict IS NULL, CASE WHEN verdict IS NULL THEN -look ELSE look END) = 1""", ["results"])
def streamed_means(spark, sf):
    """Averages decided on a stream, all results twice, each check once."""
    return _streamed(spark, sf, means=True).withColumns({"mean": F.round("mean", 8), "sd": F.round("sd", 4)})


def _starts_with(df):
    want = F.col("config")["prefix"]
    return outcome(df, F.when(want.isNull(), "no_prefix"), F.startswith(F.col("answer"), want), F.lit("other_start"))


@query("added_engine", """SELECT doc_id AS run_id, CASE WHEN lang <> 'de' THEN starts_with(text, 'The') ELSE false END AS passed,
  CASE WHEN lang = 'de' THEN 'no_prefix' WHEN NOT starts_with(text, 'The') THEN 'other_start' END AS detail, lang = 'de' AS errored FROM documents""")
def added_engine(spark, sf):
    """An engine someone registered, named by a catalogue row of theirs."""
    if "starts_with" not in registered_engines():
        register_engine("starts_with", _starts_with)
    types = check_types(spark)
    mine = types.limit(1).select(F.lit("Opening").alias("name"), F.lit("deterministic").alias("category"), F.lit("starts_with").alias("engine"),
                                 "engine_settings", F.lit(None).cast("string").alias("comparison"), "config_fields")
    d = world.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.lit("opening").alias("label"), F.lit("Opening").alias("test_type"),
        F.col("text").alias("answer"), F.lit(None).cast("string").alias("reference"), F.expr("IF(lang = 'de', cast(map() as map<string,string>), map('prefix', 'The'))").alias("config"))
    return score_checks(d, mine, metrics=()).select("run_id", "passed", "detail", "errored")


