"""Batch statistics over lineitem read as check results."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import numeric as N
from proofmill.functions.numeric import r4
from proofmill.operators import batch as B
from proofmill.plans.jobs import gate_batches

from . import world
from .registry import query, view
from .world import binomial_sql

TARGET, SURE = 0.9, 0.95
GATE_SQL = f"""
SELECT batch_id, entry_id, label, evaluated, passed, p_pass, p_fail,
  CASE WHEN p_pass <= 0.05 THEN 'pass' WHEN p_fail <= 0.05 THEN 'fail' ELSE 'inconclusive' END AS verdict
FROM (SELECT *, {binomial_sql('at_least', 'passed', 'evaluated', '0.9')} AS p_pass,
        {binomial_sql('at_most', 'passed', 'evaluated', '0.9')} AS p_fail FROM plain_fold)"""


def _folded(spark, sf):
    return B.fold_results(world.plain_results(spark, sf))


def _gated(spark, sf):
    return gate_batches(world.plain_results(spark, sf), TARGET, SURE)


@query("fold_check_results", "SELECT * FROM folded", ["folded"])
def fold_check_results(spark, sf, told=None):
    told = world.told_results(spark, sf) if told is None else told
    return B.fold(world.batch_runs(spark, sf, told), world.ran_results(spark, sf, told))


@query("gate_verdicts", f"""SELECT batch_id, entry_id, label, evaluated, passed, round(p_pass, 4) AS p_pass,
  round(p_fail, 4) AS p_fail, verdict FROM ({GATE_SQL})""", ["plain_fold"])
def gate_verdicts(spark, sf):
    return _gated(spark, sf).select("batch_id", "entry_id", "label", "evaluated", "passed",
                                    r4(F.col("p_pass")).alias("p_pass"),
                                    r4(F.col("p_fail")).alias("p_fail"), "verdict")


@query("batch_roll_up", f"""
WITH g AS ({GATE_SQL})
SELECT batch_id, count(*) AS checks_total, count(*) AS checks_applicable,
  count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'fail') AS n_fail,
  count(*) FILTER (WHERE verdict = 'inconclusive') AS n_inconclusive, 0::BIGINT AS n_none, false AS stopped,
  CASE WHEN count(*) FILTER (WHERE verdict = 'fail') > 0 THEN 'Failed'
       WHEN count(*) FILTER (WHERE verdict = 'pass') = count(*) THEN 'Passed' ELSE 'Inconclusive' END AS status
FROM g GROUP BY 1""", ["plain_fold"])
def batch_roll_up(spark, sf):
    judged = (_gated(spark, sf).withColumn("stopped", F.lit(False))
              .withColumn("not_applied", F.lit(None).cast("string")))
    runs = world.plain_results(spark, sf).select("batch_id", F.lit("Green").alias("status"))
    return B.roll_up_batches(judged, runs)


@query("check_series", """
SELECT b.batch_id, b.entry_id, t.label, b.batch_index, b.run_id, b.status,
  CASE WHEN b.status <> 'NotRan' AND NOT r.errored THEN r.passed END AS passed,
  CASE WHEN b.status <> 'NotRan' AND NOT r.errored THEN round(r.score, 4) END AS score,
  CASE WHEN b.status = 'NotRan' THEN 'no answer' WHEN r.errored IS NULL THEN 'no_result'
       WHEN r.errored THEN r.detail END AS problem
FROM runs_b b CROSS JOIN labels3 t
LEFT JOIN ran r ON r.run_id = b.run_id AND r.label = t.label""", ["runs_b", "ran", "labels3"])
def check_series(spark, sf):
    told = world.told_results(spark, sf)
    return B.series(world.batch_runs(spark, sf, told), world.ran_results(spark, sf, told))


@query("exact_rate_bounds")
def exact_rate_bounds(spark, sf):
    out = B.exact_bounds(_folded(spark, sf), SURE)
    return out.select("batch_id", "entry_id", "label", r4(F.col("lower")).alias("lower"),
                      r4(F.col("upper")).alias("upper"))


@query("wilson_rates", """
SELECT batch_id, entry_id, label, round(rate, 4) AS rate,
  round(greatest(0.0, (rate + z*z/(2*n))/(1+z*z/n) - z*sqrt(rate*(1-rate)/n + z*z/(4*n*n))/(1+z*z/n)), 4) AS rate_low,
  round(least(1.0, (rate + z*z/(2*n))/(1+z*z/n) + z*sqrt(rate*(1-rate)/n + z*z/(4*n*n))/(1+z*z/n)), 4) AS rate_high
FROM (SELECT *, passed::DOUBLE / evaluated AS rate, evaluated::DOUBLE AS n, 1.959963984540054 AS z FROM plain_fold)""",
       ["plain_fold"])
def wilson_rates(spark, sf):
    out = B.wilson_rates(_folded(spark, sf), SURE)
    return out.select("batch_id", "entry_id", "label", *[r4(F.col(c)).alias(c)
                                                         for c in ("rate", "rate_low", "rate_high")])


@query("binomial_tails", f"""
SELECT evaluated, passed, round({binomial_sql('at_least', 'passed', 'evaluated', '0.88')}, 6) AS tail_up,
  round({binomial_sql('at_most', 'passed', 'evaluated', '0.88')}, 6) AS tail_down
FROM (SELECT DISTINCT evaluated, passed FROM plain_fold)""", ["plain_fold"])
def binomial_tails(spark, sf):
    k, n = F.col("passed"), F.col("evaluated")
    return _folded(spark, sf).select("evaluated", "passed").distinct().select(
        "evaluated", "passed", F.round(N.at_least(k, n, 0.88), 6).alias("tail_up"),
        F.round(N.at_most(k, n, 0.88), 6).alias("tail_down"))


_RULE_SQL = """
pmf AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.9) + (n - k) * ln(1 - 0.9)) AS p
        FROM (SELECT DISTINCT evaluated AS n FROM plain_fold), generate_series(0, n) g(k)),
tails AS (SELECT n, k, sum(p) OVER (PARTITION BY n ORDER BY k DESC) AS up, sum(p) OVER (PARTITION BY n ORDER BY k) AS down FROM pmf)"""


@query("gate_rule_at_size", f"""
WITH {_RULE_SQL}
SELECT n, min(k) FILTER (WHERE up <= 0.05)::BIGINT AS pass_at_least, max(k) FILTER (WHERE down <= 0.05)::BIGINT AS fail_at_most
FROM tails GROUP BY n""", ["plain_fold"])
def gate_rule_at_size(spark, sf):
    sizes = _folded(spark, sf).select(F.col("evaluated").alias("n")).distinct()
    rule = B.gate_rule(F.col("n"), F.lit(TARGET), SURE)
    return sizes.withColumn("_r", rule).select("n", "_r.pass_at_least", "_r.fail_at_most")


view("own_targets", """SELECT batch_id, entry_id, label, least(0.99, greatest(0.5, round(passed::DOUBLE / evaluated, 2))) AS target
FROM plain_fold""", ["plain_fold"])


def own_targets(spark, sf):
    """Each check's own pass rate in whole percents, 50 to 99, as its target."""
    target = F.least(F.lit(0.99), F.greatest(F.lit(0.5), F.round(F.col("passed") / F.col("evaluated"), 2)))
    return _folded(spark, sf).select("batch_id", "entry_id", "label", target.alias("target"))


@query("gate_floors", """
SELECT batch_id, entry_id, label, target, CAST(ceil(ln(0.05) / ln(target) - 1e-9) AS BIGINT) AS floor FROM own_targets""", ["own_targets"])
def gate_floors(spark, sf):
    return own_targets(spark, sf).withColumn("floor", B.gate_floor(F.col("target"), SURE))


_RULES_1000 = """
r0 AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.9) + (n - k) * ln(1 - 0.9)) AS p
        FROM generate_series(1, 1000) a(n), generate_series(0, n) g(k)),
r1 AS (SELECT n, k, sum(p) OVER (PARTITION BY n ORDER BY k DESC) AS up, sum(p) OVER (PARTITION BY n ORDER BY k) AS down FROM r0),
rules AS (SELECT n, min(k) FILTER (WHERE up <= 0.05) AS pa, max(k) FILTER (WHERE down <= 0.05) AS fa FROM r1 GROUP BY n)"""


@query("runs_to_decide", f"""
WITH g AS ({GATE_SQL}), {_RULES_1000},
u AS (SELECT DISTINCT passed, evaluated, passed::DOUBLE / evaluated AS rate FROM g WHERE verdict = 'inconclusive'),
found AS (SELECT passed, evaluated, min(n) AS times FROM u, rules
  WHERE (rate > 0.9 AND round_even(rate * n, 0) >= pa) OR (rate < 0.9 AND round_even(rate * n, 0) <= fa) GROUP BY 1, 2)
SELECT batch_id, entry_id, label, verdict, CAST(CASE WHEN verdict = 'inconclusive' THEN times END AS INTEGER) AS times_to_decide
FROM g LEFT JOIN found USING (passed, evaluated)""", ["plain_fold"])
def runs_to_decide(spark, sf):
    gated = _gated(spark, sf).withColumn("target", F.lit(TARGET))
    rules = B.gate_rules(spark.range(1).select(F.lit(TARGET).alias("target")), SURE)
    return B.runs_to_decide(gated, rules).select("batch_id", "entry_id", "label", "verdict", "times_to_decide")


@query("score_summaries", """
SELECT batch_id, entry_id, label, count(*) AS n, round(avg(score), 9) AS mean, round(stddev_samp(score), 4) AS sd,
  min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.1), 4) AS p10, round(quantile_cont(score, 0.25), 4) AS p25,
  round(quantile_cont(score, 0.5), 4) AS median, round(quantile_cont(score, 0.75), 4) AS p75, round(quantile_cont(score, 0.9), 4) AS p90
FROM results WHERE NOT errored GROUP BY 1, 2, 3""", ["results"])
def score_summaries(spark, sf):
    out = B.score_summary(world.plain_results(spark, sf))
    return out.select(*B.KEYS, "n", F.round("mean", 9).alias("mean"), *[r4(F.col(c)).alias(c) for c in (
        "sd", "min", "max", "p10", "p25", "median", "p75", "p90")])


def t_tail_sql(t: str, df: str) -> str:
    """Student tail by Simpson sums over the angle, for the SQL side."""
    def area(lo, hi):
        return (f"(SELECT sum(pow(cos({lo} + ({hi} - ({lo})) * i / 2000.0), {df} - 1) * "
                f"CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
                f"* ({hi} - ({lo})) FROM generate_series(0, 2000) g(i))")
    return f"({area(f'atan({t} / sqrt({df}))', '(pi()/2)')} / {area('(-pi()/2)', '(pi()/2)')})"


_T_SQL = f"""
m AS (SELECT batch_id, entry_id, label, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd
      FROM results WHERE NOT errored GROUP BY 1, 2, 3),
t AS (SELECT *, sd / sqrt(n) AS se, (mean - 0.45) / (sd / sqrt(n)) AS t FROM m),
p AS (SELECT *, {t_tail_sql('t', '(n - 1)')} AS p_pass FROM t),
tested AS (SELECT *, 1 - p_pass AS p_fail, CASE WHEN p_pass <= 0.05 THEN 'pass' WHEN 1 - p_pass <= 0.05 THEN 'fail'
      ELSE 'inconclusive' END AS verdict FROM p)"""


def _means(spark, sf):
    return (B.score_moments(world.plain_results(spark, sf)).withColumn("threshold", F.lit(0.45))
            .withColumn("higher_passes", F.lit(True)))


@query("mean_score_tests", f"""WITH {_T_SQL}
SELECT batch_id, entry_id, label, n, round(mean, 9) AS mean, round(sd, 4) AS sd, round(t, 4) AS t,
  round(p_pass, 4) AS p_pass, round(p_fail, 4) AS p_fail, verdict FROM tested""", ["results"])
def mean_score_tests(spark, sf):
    out = B.one_sample_t(_means(spark, sf), SURE, bounds=False)
    return out.select(*B.KEYS, "n", F.round("mean", 9).alias("mean"), *[r4(F.col(c)).alias(c) for c in ("sd", "t", "p_pass", "p_fail")],
                      "verdict")


@query("mean_score_bounds")
def mean_score_bounds(spark, sf):
    out = B.t_runs_to_decide(B.one_sample_t(_means(spark, sf), SURE), SURE)
    return out.select(*B.KEYS, r4(F.col("lower")).alias("lower"), r4(F.col("upper")).alias("upper"),
                      "times_to_decide")


@query("student_tails", f"""
SELECT n, round({t_tail_sql('((n % 50) / 20.0)', '(n - 1)')}, 6) AS tail FROM (SELECT DISTINCT evaluated AS n FROM plain_fold)""",
       ["plain_fold"])
def student_tails(spark, sf):
    n = F.col("n")
    return _folded(spark, sf).select(F.col("evaluated").alias("n")).distinct().select(
        "n", F.round(N.t_above(n % 50 / 20.0, n - 1), 6).alias("tail"))


@query("agreement_verdicts", f"""
SELECT batch_id, entry_id, label, agreeing, usual, round(p_pass, 4) AS p_pass, round(p_fail, 4) AS p_fail,
  CASE WHEN p_pass <= 0.05 THEN 'pass' WHEN p_fail <= 0.05 THEN 'fail' ELSE 'inconclusive' END AS verdict
FROM (SELECT *, {binomial_sql('at_least', 'agreeing', 'evaluated', '0.9')} AS p_pass,
             {binomial_sql('at_most', 'agreeing', 'evaluated', '0.9')} AS p_fail
      FROM (SELECT *, greatest(passed, failed) AS agreeing, CASE WHEN passed >= failed THEN 'pass' ELSE 'fail' END AS usual
            FROM plain_fold))""", ["plain_fold"])
def agreement_verdicts(spark, sf):
    out = B.agreement_gate(_folded(spark, sf), TARGET, SURE)
    return out.select(*B.KEYS, "agreeing", "usual", r4(F.col("p_pass")).alias("p_pass"),
                      r4(F.col("p_fail")).alias("p_fail"), "verdict")


# ── which checks are judged, and the batch as a whole ────────────────────────

def _catalogued(spark, sf, folded):
    """The fold with each check's catalogue facts and its entry's record."""
    from proofmill.sources.catalogue import check_types
    types = check_types(spark).select(F.col("name").alias("test_type"), "comparison",
                                      F.col("engine").alias("check_engine"))
    checks = world.entries(spark, sf).select(
        "entry_id", F.col("model_output").isNotNull().alias("recorded_answer"),
        F.explode("assignments").alias("a")).select(
        "entry_id", "recorded_answer", F.col("a.label").alias("label"), F.col("a.name").alias("test_type"),
        F.col("a.config")["threshold"].alias("raw_threshold"))
    return folded.join(checks, ["entry_id", "label"]).join(types, "test_type", "left")


_CHECKS_SQL = """
checks AS (SELECT e.entry_id, t.label, t.test_type, e.model_output IS NOT NULL AS recorded_answer,
  CASE t.label WHEN 'N' THEN 'gte' END AS comparison,
  CASE t.label WHEN 'A' THEN 'exact_match' WHEN 'N' THEN 'rouge' ELSE 'llm_judge' END AS check_engine
  FROM entries e CROSS JOIN labels3 t)"""


@query("check_applicability", f"""WITH {_CHECKS_SQL}
SELECT entry_id, label, CASE WHEN comparison IS NULL THEN 'no_score' END AS average_test,
  CASE WHEN check_engine <> 'llm_judge' THEN 'not_a_judge' WHEN NOT recorded_answer THEN 'answer_varies' END AS judge_test,
  'no_verdict_in_trial' AS trial FROM checks""", ["entries", "labels3"])
def check_applicability(spark, sf):
    keys = world.entries(spark, sf).select("entry_id", F.explode("assignments.label").alias("label"))
    return _catalogued(spark, sf, keys).select(
        "entry_id", "label", B.applies("one_sample_t").alias("average_test"),
        B.applies("judge_stability").alias("judge_test"), B.applies("trial").alias("trial"))


def _override_frames(spark, sf):
    """Targets and left-out checks a batch set, from part of the suppliers' balances."""
    s = world.table(spark, sf, "supplier")
    base = s.select(F.lit("F").alias("batch_id"), F.col("s_suppkey").alias("entry_id"), "s_acctbal")
    own = base.filter("s_acctbal > 5000").select("batch_id", "entry_id", F.lit("A").alias("label"),
                                                 F.lit(0.8).alias("target"))
    out = base.filter("s_acctbal < 0").select("batch_id", "entry_id", F.lit("R").alias("label"))
    return own, out


_OVER_SQL = """
over AS (SELECT f.*, CASE WHEN f.batch_id = 'F' AND f.label = 'A' AND s.s_acctbal > 5000 THEN 0.8 ELSE 0.9 END::DOUBLE AS target,
  f.batch_id = 'F' AND f.label = 'R' AND s.s_acctbal < 0 AS left_out
  FROM folded f JOIN supplier s ON s.s_suppkey = f.entry_id)"""


def _overridden(spark, sf, told=None):
    own, out = _override_frames(spark, sf)
    return B.apply_overrides(fold_check_results(spark, sf, told), own, out, TARGET)


@query("check_overrides", f"WITH {_OVER_SQL} SELECT batch_id, entry_id, label, target, left_out FROM over", ["folded"])
def check_overrides(spark, sf):
    return _overridden(spark, sf).select("batch_id", "entry_id", "label", "target", "left_out")


_JUDGED_SQL = f"""{_OVER_SQL},
judged AS (SELECT batch_id, entry_id, label, target, evaluated, batch_id = 'O' AS stopped,
  CASE WHEN left_out THEN 'left_out' END AS not_applied,
  CASE WHEN left_out THEN NULL WHEN evaluated = 0 THEN 'no_result'
       WHEN batch_id = 'O' AND evaluated < ceil(ln(0.01) / ln(target) - 1e-9) THEN 'stopped_below_floor' END AS no_verdict,
  {binomial_sql('at_least', 'passed', 'evaluated', 'target')} AS pp,
  {binomial_sql('at_most', 'passed', 'evaluated', 'target')} AS pf FROM over),
verdicts AS (SELECT *, CASE WHEN not_applied IS NULL AND no_verdict IS NULL THEN
  CASE WHEN pp <= 0.01 THEN 'pass' WHEN pf <= 0.01 THEN 'fail' ELSE 'inconclusive' END END AS verdict FROM judged)"""


def _judged(spark, sf, told=None):
    checks = _catalogued(spark, sf, _overridden(spark, sf, told)).withColumn("stopped", F.col("batch_id") == "O")
    return B.judge_checks(checks, "binomial_gate", 0.99)


@query("judged_check_results", f"""WITH {_JUDGED_SQL}
SELECT batch_id, entry_id, label, target, evaluated, not_applied, no_verdict, verdict FROM verdicts""", ["folded"])
def judged_check_results(spark, sf):
    return _judged(spark, sf).select("batch_id", "entry_id", "label", "target", "evaluated", "not_applied",
                                     "no_verdict", "verdict")


@query("average_check_results", f"""
WITH {_CHECKS_SQL}, {_T_SQL.replace('0.45', "0.5").replace("<= 0.05", "<= 0.10")}
SELECT m.batch_id, m.entry_id, m.label, m.n, CASE WHEN c.comparison IS NULL THEN 'no_score' END AS not_applied,
  CASE WHEN c.comparison IS NULL THEN NULL WHEN m.n < 85 THEN 'too_few_scores' END AS no_verdict,
  CASE WHEN c.comparison IS NOT NULL AND m.n >= 85 THEN m.verdict END AS verdict
FROM tested m JOIN checks c USING (entry_id, label)""", ["results", "entries", "labels3"])
def average_check_results(spark, sf):
    moments = B.score_moments(world.plain_results(spark, sf))
    checks = (_catalogued(spark, sf, moments).withColumn("stopped", F.lit(False)).withColumn("left_out", F.lit(False))
              .withColumn("threshold", F.lit(0.5)).withColumn("higher_passes", F.lit(True)))
    return B.judge_checks(checks, "one_sample_t", 0.9, floor=85).select(
        "batch_id", "entry_id", "label", "n", "not_applied", "no_verdict", "verdict")


@query("batch_status_roll_up", f"""WITH {_JUDGED_SQL}
SELECT batch_id, count(*) AS checks_total, count(*) FILTER (WHERE not_applied IS NULL) AS checks_applicable,
  count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'fail') AS n_fail,
  count(*) FILTER (WHERE verdict = 'inconclusive') AS n_inconclusive,
  count(*) FILTER (WHERE not_applied IS NULL AND verdict IS NULL) AS n_none, bool_or(stopped) AS stopped,
  CASE WHEN bool_or(stopped) THEN 'Incomplete' WHEN count(*) FILTER (WHERE verdict = 'fail') > 0 THEN 'Failed'
       WHEN count(*) FILTER (WHERE verdict = 'pass') = count(*) FILTER (WHERE not_applied IS NULL) THEN 'Passed'
       ELSE 'Inconclusive' END AS status FROM verdicts GROUP BY 1""", ["folded"])
def batch_status_roll_up(spark, sf):
    told = world.told_results(spark, sf)
    return B.roll_up_batches(_judged(spark, sf, told), world.batch_runs(spark, sf, told))


_RUN_PASSED = """
rp AS (SELECT batch_id, entry_id, batch_index, bool_and(passed) FILTER (WHERE NOT errored) AS run_passed FROM ran GROUP BY 1, 2, 3),
eo AS (SELECT batch_id, entry_id, count(*) FILTER (WHERE run_passed) AS passed, count(*) FILTER (WHERE NOT run_passed) AS failed
       FROM rp GROUP BY 1, 2)"""


def _entry_outcomes(spark, sf):
    from proofmill.operators.rollup import run_passed
    keys = ["batch_id", "entry_id", "batch_index"]
    return B.entry_outcomes(run_passed(world.ran_results(spark, sf), keys))


@query("failures_by_entry", f"""WITH {_RUN_PASSED},
t AS (SELECT batch_id, sum(passed)::DOUBLE AS p, sum(failed)::DOUBLE AS f, count(*) AS k FROM eo GROUP BY 1)
SELECT batch_id, k AS entries, k AS counted, CAST(p AS BIGINT) AS passes, CAST(f AS BIGINT) AS fails,
  (SELECT round(sum(pow(e.passed - (e.passed + e.failed) * p / (p + f), 2) / ((e.passed + e.failed) * p / (p + f))
     + pow(e.failed - (e.passed + e.failed) * f / (p + f), 2) / ((e.passed + e.failed) * f / (p + f))), 4)
   FROM eo e WHERE e.batch_id = t.batch_id) AS chi_square, k - 1 AS df,
  (SELECT min((e.passed + e.failed) * least(p, f) / (p + f)) < 5 FROM eo e WHERE e.batch_id = t.batch_id) AS approximate
FROM t""", ["ran"])
def failures_by_entry(spark, sf):
    return B.failures_by_entry(_entry_outcomes(spark, sf), SURE).select(
        "batch_id", "entries", "counted", "passes", "fails", r4(F.col("chi_square")).alias("chi_square"), "df",
        "approximate")


@query("failure_concentration")
def failure_concentration(spark, sf):
    return B.failures_by_entry(_entry_outcomes(spark, sf), SURE).select("batch_id", r4(F.col("p_value")).alias("p_value"),
                                                                     "verdict", "reason")


@query("worst_entries", f"""WITH {_RUN_PASSED}
SELECT eo.*, e.name, round(failed::DOUBLE / (passed + failed), 9) AS failed_share FROM eo JOIN entries e USING (entry_id)""",
       ["ran", "entries"])
def worst_entries(spark, sf):
    named = _entry_outcomes(spark, sf).join(world.entries(spark, sf).select("entry_id", "name"), "entry_id")
    return B.worst_entries(named).withColumn("failed_share", F.round("failed_share", 9))


@query("entry_order", "SELECT entry_id, test_set_name, name FROM entries ORDER BY lower(test_set_name), lower(name), CAST(entry_id AS VARCHAR)", ["entries"])
def entry_order(spark, sf):
    return world.entries(spark, sf).orderBy(*B.entry_order()).select("entry_id", "test_set_name", "name")


def _scope_batch_runs(spark, sf):
    year = F.year("created_at")
    return (world.scope_runs(spark, sf).filter("batch_id is not null")
            .withColumn("batch_index", F.quarter("created_at")).withColumn("entry_id", F.col("scope_id"))
            .withColumn("asks_app", F.when(F.col("weight") > 400000, 1).otherwise(0))
            .withColumn("judge_checks", F.when(F.col("weight") > 450000, 2).otherwise(0))
            .withColumn("error", F.lit(None).cast("string")).withColumn("year", year))


_SB_SQL = """
sb AS (SELECT *, quarter(created_at) AS batch_index, CASE WHEN weight > 400000 THEN 1 ELSE 0 END AS asks_app,
  CASE WHEN weight > 450000 THEN 2 ELSE 0 END AS judge_checks, status IN ('Pending', 'Running') AS open
  FROM sruns WHERE batch_id IS NOT NULL)"""


@query("batch_progress", f"""WITH {_SB_SQL},
ss AS (SELECT * REPLACE (CASE WHEN status = 'Pending' AND run_id % 3 = 0 THEN 'Running' ELSE status END AS status), status = 'NotRan' AND run_id % 2 = 0 AS halted FROM sb),
t AS (SELECT batch_id, count(*) FILTER (WHERE NOT o) AS times_done, count(*) FILTER (WHERE c) AS times_cancelled
  FROM (SELECT batch_id, batch_index, bool_or(open) AS o, bool_and(halted) AS c FROM ss GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT batch_id, count(*) AS runs, count(*) FILTER (WHERE NOT open) AS runs_done, count(*) FILTER (WHERE halted) AS runs_cancelled,
  {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ('Pending', 'Running', 'Green', 'Amber', 'Red', 'NotRan'))},
  CAST(coalesce(sum(asks_app) FILTER (WHERE NOT open AND NOT halted), 0) AS BIGINT) AS app_done,
  CAST(coalesce(sum(asks_app) FILTER (WHERE status = 'Running'), 0) AS BIGINT) AS app_open,
  CAST(coalesce(sum(judge_checks) FILTER (WHERE status IN ('Green', 'Amber', 'Red')), 0) AS BIGINT) AS judge_done,
  CAST(coalesce(sum(judge_checks) FILTER (WHERE status = 'Running'), 0) AS BIGINT) AS judge_open,
  count(DISTINCT batch_index) AS times_requested, count(DISTINCT batch_index) * max(asks_app)::BIGINT AS app_planned,
  count(DISTINCT batch_index) * max(judge_checks)::BIGINT AS judge_planned FROM ss GROUP BY 1)
SELECT * FROM r JOIN t USING (batch_id)""", ["sruns"])
def batch_progress(spark, sf):
    """A third of the open runs are running, and a stop cancelled every other
    run that did not run."""
    runs = _scope_batch_runs(spark, sf)
    runs = (runs.withColumn("error", F.when((F.col("status") == "NotRan") & (F.col("run_id") % 2 == 0), B.STOP_REASON))
            .withColumn("status", F.when((F.col("status") == "Pending") & (F.col("run_id") % 3 == 0), "Running").otherwise(F.col("status"))))
    plans = runs.groupBy("batch_id").agg(F.count_distinct("batch_index").alias("times_requested"), F.max("asks_app").cast("long").alias("app_per_time"),
                                         F.max("judge_checks").cast("long").alias("judge_per_time"))
    return B.batch_progress(runs, plans)


@query("live_batch_status", """
SELECT batch_id, CASE WHEN bool_and(status = 'Pending') THEN 'Pending'
  WHEN bool_or(status IN ('Pending', 'Running')) OR count(*) = 1 THEN 'Running' END AS live_status
FROM sruns WHERE batch_id IS NOT NULL GROUP BY 1""", ["sruns"])
def live_batch_status(spark, sf):
    batches = world.scope_batches(spark, sf).select("batch_id", (F.col("runs") == 1).alias("waves_left"))
    return B.live_status(_scope_batch_runs(spark, sf), batches)


@query("runs_matrix", "SELECT batch_id, entry_id, batch_index, run_id, status FROM runs_b", ["runs_b"])
def runs_matrix(spark, sf):
    return B.runs_matrix(world.batch_runs(spark, sf))


@query("trial_rates", """SELECT batch_id, entry_id, label, evaluated, passed, round(passed::DOUBLE / evaluated, 4) AS rate,
  CAST(NULL AS VARCHAR) AS verdict FROM folded""", ["folded"])
def trial_rates(spark, sf):
    return B.trial_summary(fold_check_results(spark, sf), SURE).select(
        "batch_id", "entry_id", "label", "evaluated", "passed", r4(F.col("rate")).alias("rate"), "verdict")


@query("stopped_batches", """
SELECT run_id, batch_id, CASE WHEN status = 'Pending' AND batch_id IN (SELECT batch_id FROM sbatches WHERE runs > 1)
    THEN 'NotRan' ELSE status END AS status,
  CASE WHEN status = 'Pending' AND batch_id IN (SELECT batch_id FROM sbatches WHERE runs > 1) THEN 'stopped by request' END AS error
FROM sruns WHERE batch_id IS NOT NULL""", ["sruns", "sbatches"])
def stopped_batches(spark, sf):
    hit = world.scope_batches(spark, sf).filter("runs > 1")
    return B.stop_batch(_scope_batch_runs(spark, sf), hit, "stopped by request").select("run_id", "batch_id", "status", "error")
