"""Single rows that must not stop a job or change another row's result."""
from pyspark.sql import functions as F

from proofmill.functions import jsonpath as J
from proofmill.operators import batch as B
from proofmill.operators import comparisons as C
from proofmill.operators import planning as P
from proofmill.operators.checks import against_threshold, fixed
from proofmill.streaming import runs as R


def test_bad_patterns_are_their_own_error(spark):
    rows = [(i, p, "abc") for i, p in enumerate(["[z-a]", "a{3,1}", "[a--z]", "[a&&b]", "b", "[a-c]+"])]
    df = spark.createDataFrame(rows, "run_id long, pattern string, answer string").select(
        "run_id", "answer", F.lit("re").alias("label"), F.lit(None).cast("string").alias("reference"), F.lit("regex").alias("engine"),
        F.create_map(F.lit("pattern"), "pattern").alias("config"), F.expr("cast(map() as map<string,string>)").alias("settings"),
        F.expr("cast(map() as map<string,string>)").alias("engine_settings"))
    got = {r.run_id: (r.passed, r.detail) for r in fixed.check_regex(df, mode="search", negate=False, lookalikes=False).collect()}
    assert [got[i] for i in range(3)] == [(False, "invalid_pattern")] * 3
    assert [got[i][0] for i in (3, 4, 5)] == [True] * 3


def test_an_index_beyond_int_is_no_path(spark):
    df = spark.createDataFrame([("$.k[99999999999]",), ("$.k[1]",)], "path string").withColumn("doc", F.try_parse_json(F.lit('{"k": [1, 2]}')))
    assert [r[0] for r in df.select(J.at_path(F.col("doc"), F.col("path")).cast("string")).collect()] == [None, "2"]


def test_thresholds_that_are_no_numbers(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("NaN", "lte"), ("NaN", "gte"), ("0.5d", "gte"), ("5e-1", "gte"), (" .5 ", "gte"), ("inf", "lte")])],
                               "run_id long, t string, comparison string").select(
        "run_id", "comparison", F.lit("x").alias("label"), F.lit("r").alias("reference"), F.lit(0.7).alias("raw_score"), F.create_map(F.lit("threshold"), "t").alias("config"))
    got = {r.run_id: (r.passed, r.errored) for r in against_threshold(df).collect()}
    assert [got[i] for i in range(6)] == [(False, False), (False, False), (False, True), (True, False), (True, False), (True, False)]


def test_many_pairs_never_reach_the_exact_tail(spark):
    pairs = spark.range(300_000).select(F.lit(1).alias("k"), F.lit(0.0).alias("rate_a"), ((F.col("id") % 1000 - 480) / 1000).alias("rate_b"))
    row = C.compare_paired(pairs, ["k"], 0.95).collect()[0]
    assert row.wilcoxon_method == "normal" and row.n_pairs == 300_000


def test_a_batch_without_checks_has_a_status(spark):
    runs = spark.createDataFrame([("b", "Green"), ("c", "NotRan")], "batch_id string, status string")
    judged = spark.createDataFrame([], "batch_id string, verdict string, not_applied string, stopped boolean")
    assert {r.batch_id: (r.status, r.checks_total) for r in B.roll_up_batches(judged, runs).collect()} == {"b": ("Passed", 0), "c": ("NotRan", 0)}


def test_asked_times_are_never_lowered(spark):
    types = spark.createDataFrame([("t", "e")], "name string, engine string")
    scope = spark.range(12_000).select(F.lit("set").alias("scope_kind"), F.lit(1).alias("scope_id"), F.col("id").alias("entry_id"),
                                       F.lit(None).cast("string").alias("model_output"), F.expr("array(named_struct('name', 't'))").alias("assignments"))
    row = P.estimate_cost(scope, types, 600).collect()[0]
    assert (row.times, row.problem, row.runs_total) == (600, "too_many_runs", 7_200_000)


def test_progress_counts_attempts_and_what_runs(spark):
    rows = [(1, "Green", None), (1, "Running", None), (2, "NotRan", B.STOP_REASON), (3, "NotRan", "no reply"), (3, "Pending", None)]
    runs = spark.createDataFrame([("b", *r) for r in rows], "batch_id string, batch_index int, status string, error string").selectExpr("*", "1 AS asks_app", "2 AS judge_checks")
    plans = spark.createDataFrame([("b", 30, 1, 2)], "batch_id string, times_requested int, app_per_time int, judge_per_time int")
    row = B.batch_progress(runs, plans).collect()[0]
    assert (row.app_done, row.app_open, row.judge_done, row.judge_open) == (2, 1, 2, 2)
    assert (row.runs_done, row.runs_cancelled, row.times_done, row.times_cancelled, row.app_planned, row.judge_planned) == (3, 1, 1, 1, 30, 60)


def _planned(spark, checks):
    rows = spark.createDataFrame(checks, "scope_id int, label string, passed long, failed long, target double, certain boolean")
    rules = B.gate_rules(spark.createDataFrame([(0.8,), (0.95,)], "target double"), 0.95, 120)
    return rows, P.answer_chance(rows, P.size_grid(rules))


def test_checks_of_two_targets_are_planned_at_common_sizes(spark):
    rows, chances = _planned(spark, [(1, "a", 40, 0, 0.8, False), (1, "b", 40, 0, 0.95, False), (2, "a", 40, 0, 0.8, False)])
    curve = {(r.scope_id, r.n): r.chance for r in P.odds_curve(rows, chances).collect()}
    assert curve[1, 14] < 0.05 and curve[1, 30] < 0.05 and curve[1, 59] > 0.3
    alone = {n for s, n in curve if s == 2}
    assert alone < {n for s, n in curve if s == 1} and 59 not in alone


def test_beside_certain_checks_all_others_may_go(spark):
    bad = [("a", 10, 10), ("b", 12, 8)]
    rows, chances = _planned(spark, [(1, n, p, f, 0.8, False) for n, p, f in bad] + [(1, "sure", 40, 0, 0.8, True)]
                             + [(2, n, p, f, 0.8, False) for n, p, f in bad] + [(3, "a", 0, 200, 0.8, False)])
    got = {r.scope_id: (r.left_out, r.times) for r in P.fewest_left_out(rows, chances).collect()}
    assert 3 not in got and got[1][0] <= 2 and got.get(2, (1,))[0] == 1


def test_a_late_start_does_not_open_a_run_again(spark, tmp_path):
    for i, rows in enumerate(([(1, 1, "2024-01-01 00:00:00", "Pending"), (2, 1, "2024-01-01 00:05:00", "Green"), (3, 2, "2024-01-01 00:00:00", "Pending")],
                              [(1, 1, "2024-01-01 00:00:00", "Pending"), (4, 3, "2024-01-01 00:20:00", "Green")], [(5, 4, "2024-01-02 00:00:00", "Green")])):
        df = spark.createDataFrame(rows, "event_id long, run_id long, t string, status string").selectExpr("event_id", "run_id", "'b' AS batch_id", "timestamp(t) AS ts", "status")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema("event_id long, run_id long, batch_id string, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    folder, _ = R.to_table(R.stream_stale_pending(stream()), "append", "stale")
    assert [r.run_id for r in spark.read.schema("run_id long, pending_since timestamp").parquet(folder).collect()] == [2]
    folder, _ = R.to_table(R.stream_run_state(stream()), "update", "state")
    rows = R.progress(R.newest_rows(spark, folder, ["run_id"], "run_id long, batch_id string, status string, ts timestamp")).collect()
    assert [(r.runs, r.pending, r.green) for r in rows] == [(4, 1, 3)]


def test_json_numbers_are_equal_by_value_at_any_depth(spark):
    rows = [('{"a":1e2}', '{"a":100}', True), ('[1.50, {"b": "1e2 \\"x"}]', '[1.5, {"b": "1e2 \\"x"}]', True), ('{"a":"100"}', '{"a":100}', False), ("1e20", "100000000000000000000", True),
            ("[9007199254740993]", "[9007199254740992]", False), ("-0.0", "0", True), ("true", "1", False), ("[1,2]", "[12]", False), ("[0.1]", "[1e-1]", True), ('{"b":1,"a":2}', '{"a":2.0,"b":1}', True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", J.same_json(F.try_parse_json("a"), F.try_parse_json("b")).alias("got")).collect())


def test_fences(spark):
    rows = [("```json\n{}\n```", "{}"), (" \n```\n{}```  \n", "{}"), ("```", "```"), ("```\n```", ""), ("``````", "``````"), ("```json {}```", "```json {}```"), ("```js9\n{}\n```", "```js9\n{}\n```"),
            ("```json \t\n{}\n\n \t```", "{}\n"), ("```\n{}\n``` x", "```\n{}\n``` x"), (None, None)]
    assert all(r.want == r.got for r in spark.createDataFrame(rows, "t string, want string").select("want", J.unfenced(F.col("t")).alias("got")).collect() if r.want or r.got)
