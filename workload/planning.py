"""Sequential decisions and planning from history, over lineitem results."""
from __future__ import annotations

from pyspark.sql import functions as F


from proofmill.functions.numeric import r4
from proofmill.operators import batch as B
from proofmill.operators import planning as P
from proofmill.operators import sequential as Q
from proofmill.session import kept
from proofmill.sources.catalogue import check_types

from . import world
from .batches import _RULES_1000, _catalogued, own_targets, t_tail_sql
from .registry import query, view
from .world import binomial_sql


@query("look_schedules", """
WITH s AS (SELECT DISTINCT s_suppkey % 90 + 5 AS f, s_suppkey % 90 + 5 + s_nationkey * 7 AS m FROM supplier),
x AS (SELECT f, m, least(8, m - f + 1) AS c FROM s),
p AS (SELECT DISTINCT f, m, CASE WHEN m <= f THEN f ELSE f + CAST(round_even((m - f)::DOUBLE / (c - 1) * i, 0) AS BIGINT) END AS look FROM x, generate_series(0, 7) g(i) WHERE i < greatest(c, 1)
  UNION SELECT f, m, greatest(m, f) FROM x)
SELECT f AS first, m AS maximum, string_agg(look::VARCHAR, ',' ORDER BY look) AS looks FROM p GROUP BY 1, 2""")
def look_schedules(spark, sf):
    s = world.table(spark, sf, "supplier").select((F.col("s_suppkey") % 90 + 5).alias("first"),
                                                  (F.col("s_suppkey") % 90 + 5 + F.col("s_nationkey") * 7).alias("maximum")).distinct()
    return s.withColumn("looks", F.array_join(Q.looks(F.col("first"), F.col("maximum")), ","))


# batch F looks from its 45th time to its last, batch O from its 60th; even levels
def _plans(spark, sf):
    size = world.check_sizes(spark, sf).groupBy("batch_id").agg(F.max("times").alias("_n"))
    p = size.withColumn("looks", Q.looks(F.when(F.col("batch_id") == "F", 45).otherwise(60), F.col("_n")))
    return p.withColumn("level", Q.even_level(F.col("looks"), 0.95)).withColumn("target", F.lit(0.9)).drop("_n")


view("plooks", """
WITH x AS (SELECT *, least(8, m - f + 1) AS c FROM (SELECT batch_id, CASE WHEN batch_id = 'F' THEN 45 ELSE 60 END AS f, max(batch_index) AS m FROM results GROUP BY 1)),
p AS (SELECT DISTINCT batch_id, CASE WHEN m <= f THEN f ELSE f + CAST(round_even((m - f)::DOUBLE / (c - 1) * i, 0) AS BIGINT) END AS look FROM x, generate_series(0, 7) g(i) WHERE i < greatest(c, 1)
  UNION SELECT batch_id, greatest(m, f) FROM x)
SELECT batch_id, look, 1 - 0.05 / count(*) OVER (PARTITION BY batch_id) AS level FROM p""", ["results"])
view("at_looks", """SELECT r.batch_id, r.entry_id, r.label, l.look, l.level, count(*) AS evaluated, count(*) FILTER (WHERE r.passed) AS passes,
  avg(r.score) AS mean, stddev_samp(r.score) AS sd FROM ran r JOIN plooks l ON l.batch_id = r.batch_id AND r.batch_index <= l.look WHERE NOT r.errored GROUP BY 1, 2, 3, 4, 5""", ["ran", "plooks"])


def _decided_sql(counted: str) -> str:
    return f"""
v AS (SELECT *, CASE WHEN {binomial_sql('at_least', 'k', 'evaluated', '0.9')} <= 1 - level THEN 'pass'
  WHEN {binomial_sql('at_most', 'k', 'evaluated', '0.9')} <= 1 - level THEN 'fail' END AS verdict FROM (SELECT *, {counted} AS k FROM at_looks)),
d AS (SELECT * FROM v WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id, entry_id, label ORDER BY look) = 1),
z AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY batch_id, entry_id, label ORDER BY look DESC) = 1),
decided AS (SELECT z.batch_id, z.entry_id, z.label, d.verdict, CAST(d.look AS INTEGER) AS at_time, coalesce(d.k, z.k) AS passes, coalesce(d.evaluated, z.evaluated) AS evaluated
  FROM z LEFT JOIN d USING (batch_id, entry_id, label))"""


@query("sequential_verdicts", f"WITH {_decided_sql('passes')} SELECT * FROM decided", ["at_looks"])
def sequential_verdicts(spark, sf):
    return Q.decide(Q.outcomes(world.ran_apart(spark, sf)), _plans(spark, sf))


@query("sequential_agreement", f"WITH {_decided_sql('greatest(passes, evaluated - passes)')} SELECT * FROM decided", ["at_looks"])
def sequential_agreement(spark, sf):
    return Q.decide(Q.outcomes(world.ran_apart(spark, sf)), _plans(spark, sf), agreement=True)


@query("sequential_means", f"""
WITH t AS (SELECT *, (mean - 0.45) / (sd / sqrt(evaluated)) AS t FROM at_looks),
p AS (SELECT *, {t_tail_sql('t', '(evaluated - 1)')} AS pp FROM t),
v AS (SELECT *, CASE WHEN pp <= 1 - level THEN 'pass' WHEN 1 - pp <= 1 - level THEN 'fail' END AS verdict FROM p),
d AS (SELECT * FROM v WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id, entry_id, label ORDER BY look) = 1),
z AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY batch_id, entry_id, label ORDER BY look DESC) = 1)
SELECT z.batch_id, z.entry_id, z.label, d.verdict, CAST(d.look AS INTEGER) AS at_time, coalesce(d.evaluated, z.evaluated) AS n, round(coalesce(d.mean, z.mean), 9) AS mean, round(coalesce(d.sd, z.sd), 4) AS sd
FROM z LEFT JOIN d USING (batch_id, entry_id, label)""", ["at_looks"])
def sequential_means(spark, sf):
    plans = _plans(spark, sf).drop("target").withColumn("threshold", F.lit(0.45)).withColumn("higher_passes", F.lit(True))
    return Q.decide_mean(Q.scores(world.ran_apart(spark, sf)), plans).withColumn("mean", F.round("mean", 9)).withColumn("sd", r4(F.col("sd")))


@query("look_levels", "SELECT batch_id, count(*) AS looks, round(min(level), 6) AS level FROM plooks GROUP BY 1", ["plooks"])
def look_levels(spark, sf):
    return _plans(spark, sf).select("batch_id", F.size("looks").cast("long").alias("looks"), F.round("level", 6).alias("level"))


@query("judged_by_average", "SELECT entry_id, label, 0.45::DOUBLE AS threshold FROM entries CROSS JOIN labels3 WHERE label = 'N'", ["entries", "labels3"])
def judged_by_average(spark, sf):
    return _judged(spark, sf, "sequential_t").select("entry_id", "label", "threshold")


def _judged(spark, sf, engine):
    keys = world.entries(spark, sf).select("entry_id", F.explode("assignments.label").alias("label"))
    return Q.judged_checks(_catalogued(spark, sf, keys).withColumn("left_out", F.lit(False)), engine)


@query("judged_for_stability", "SELECT entry_id, label FROM entries CROSS JOIN labels3 WHERE label = 'R' AND model_output IS NOT NULL", ["entries", "labels3"])
def judged_for_stability(spark, sf):
    return _judged(spark, sf, "sequential_judge_stability").select("entry_id", "label")


@query("sequential_outcomes", "SELECT batch_id, entry_id, label, batch_index, passed FROM ran WHERE NOT errored", ["ran"])
def sequential_outcomes(spark, sf):
    return Q.outcomes(world.ran_apart(spark, sf))


@query("sequential_scores", "SELECT batch_id, entry_id, label, batch_index, score FROM ran WHERE NOT errored", ["ran"])
def sequential_scores(spark, sf):
    return Q.scores(world.ran_apart(spark, sf))


@query("batch_advances", f"""WITH {_decided_sql('passes')},
u AS (SELECT batch_id, count(*) - count(verdict) AS undecided FROM decided GROUP BY 1),
l AS (SELECT batch_id, list(look ORDER BY look) AS looks FROM plooks GROUP BY 1),
nx AS (SELECT batch_id, coalesce(undecided, 0) AS undecided, looks, batch_id = 'O' OR coalesce(undecided, 0) = 0 OR len(looks) <= 2 AS done FROM l LEFT JOIN u USING (batch_id))
SELECT batch_id, undecided, done, CASE WHEN NOT done THEN CAST(looks[2] + 1 AS INTEGER) END AS first, CASE WHEN NOT done THEN CAST(looks[3] AS INTEGER) END AS last FROM nx""", ["at_looks", "plooks"])
def batch_advances(spark, sf):
    plans = _plans(spark, sf).withColumn("waves_released", F.when(F.col("batch_id") == "F", 2).otherwise(F.size("looks")))
    decided = sequential_verdicts(spark, sf)
    return Q.advance(plans, decided.select("batch_id", "entry_id", "label"), decided)


@query("stalled_batches", "SELECT batch_id FROM sbatches b WHERE runs > 1 AND status = 'Running' AND batch_id NOT IN (SELECT batch_id FROM sruns WHERE batch_id IS NOT NULL AND weight > 400000 AND status = 'Pending')", ["sbatches", "sruns"])
def stalled_batches(spark, sf):
    batches = world.scope_batches(spark, sf).withColumn("waves_released", F.when(F.col("runs") > 1, F.col("runs")))
    runs = world.scope_runs(spark, sf).filter("batch_id is not null")
    # cheap runs were cancelled since
    runs = runs.withColumn("status", F.when(F.col("weight") > 400000, F.col("status")).otherwise("NotRan"))
    return Q.stalled_batches(batches, runs).select("batch_id")


# ── planning ─────────────────────────────────────────────────────────────────

def _history(spark, sf):
    runs = world.batch_runs(spark, sf).withColumn("executed_at", F.col("batch_index"))
    return P.check_history(runs, world.ran_apart(spark, sf))


view("hist", """
WITH n AS (SELECT run_id FROM runs_b WHERE status <> 'NotRan' QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY batch_index DESC, run_id DESC) <= 200)
SELECT entry_id, label, count(*) AS runs, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(score) AS scores, avg(score) AS mean, stddev_samp(score) AS sd
FROM ran JOIN n USING (run_id) WHERE NOT errored GROUP BY 1, 2""", ["runs_b", "ran"])


@query("check_histories", "SELECT entry_id, label, runs, passed, failed, scores, round(mean, 9) AS mean, round(sd, 4) AS sd FROM hist", ["hist"])
def check_histories(spark, sf):
    return _history(spark, sf).withColumn("mean", F.round("mean", 9)).withColumn("sd", r4(F.col("sd")))


@query("standalone_histories", """
SELECT o_custkey AS test_id, o_orderkey AS run_id FROM (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 1000) WHERE o_orderstatus = 'F'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 200""")
def standalone_histories(spark, sf):
    """A copy matches its test when the order was filled."""
    o = world.table(spark, sf, "orders")
    status = F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in world.STATUS_OF.items()])
    runs = o.select(F.col("o_custkey").alias("test_id"), F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("executed_at"))
    from proofmill.operators.authoring import assignment_list
    checks = assignment_list([{"name": "Contains", "label": "c", "config": {"substring": "x"}}])
    content = lambda key, text: [F.col(key), text.alias("input"), F.lit(None).cast("string").alias("expected_output"), F.lit("r").alias("model_output"), checks.alias("assignments")]
    copies = o.select(*content("o_orderkey", F.concat(F.lit("q-"), "o_orderstatus"))).withColumnRenamed("o_orderkey", "run_id")
    tests = world.table(spark, sf, "customer").select(*content("c_custkey", F.lit("q-F"))).withColumnRenamed("c_custkey", "test_id")
    return P.standalone_history(runs, copies, tests)


def _targeted(spark, sf):
    """Histories as planned checks: scope = set, target 0.8; checks of one label are certain."""
    e = world.entries(spark, sf).select("entry_id", F.col("test_set_id").alias("scope_id"))
    return _history(spark, sf).join(e, "entry_id").withColumn("target", F.lit(0.8)).withColumn("certain", F.col("label") == "N")


def _checks(spark, sf):
    """The same written once: a few numbers a check, read by every step of a plan."""
    return kept(_targeted(spark, sf), "checks")


def _peaks(spark, *targets, confidence=0.95):
    rows = spark.createDataFrame([(t,) for t in targets], "target double")
    return P.size_grid(kept(B.gate_rules(rows, confidence), "rules"))


_R8 = _RULES_1000.replace("0.9", "0.8")
_BB = "exp(lgamma(n+1)-lgamma(k+1)-lgamma(n-k+1)+lgamma(a+k)+lgamma(b+n-k)-lgamma(a+b+n)-lgamma(a)-lgamma(b)+lgamma(a+b))"
_CH_SQL = f"""{_R8},
peaks AS (SELECT min(n) AS n FROM rules WHERE pa IS NOT NULL GROUP BY n - pa),
sz AS (SELECT r.* FROM rules r JOIN peaks USING (n)),
sh AS (SELECT DISTINCT passed, failed, passed + 1.0 AS a, failed + 1.0 AS b FROM hist),
bb AS (SELECT passed, failed, n, pa, fa, k, {_BB} AS p FROM sh, sz, generate_series(0, n) g(k)),
ch AS (SELECT passed, failed, n, pa AS pass_at_least, fa AS fail_at_most, sum(p) FILTER (WHERE k >= pa) AS passes, coalesce(sum(p) FILTER (WHERE k <= fa), 0) AS fails FROM bb GROUP BY 1, 2, 3, 4, 5)"""


@query("gate_peaks", """
WITH r0 AS (SELECT target, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(target) + (n - k) * ln(1 - target)) AS p
  FROM (SELECT DISTINCT target FROM own_targets), generate_series(1, 1000) a(n), generate_series(0, n) g(k)),
r1 AS (SELECT target, n, k, sum(p) OVER (PARTITION BY target, n ORDER BY k DESC) AS up FROM r0),
rules AS (SELECT target, n, min(k) AS pa FROM r1 WHERE up <= 0.05 GROUP BY 1, 2)
SELECT target, CAST(n - pa AS BIGINT) AS misses, CAST(min(n) AS BIGINT) AS n FROM rules GROUP BY 1, 2""", ["own_targets"])
def gate_peaks(spark, sf):
    return B.runs_allowing(B.gate_rules(own_targets(spark, sf), 0.95)).select("target", "misses", "n")


@query("answer_chances", f"WITH {_CH_SQL} SELECT passed, failed, CAST(n AS INTEGER) AS n, round(passes, 4) AS passes, round(fails, 4) AS fails FROM ch", ["hist"])
def answer_chances(spark, sf):
    return P.answer_chance(_targeted(spark, sf), _peaks(spark, 0.8)).select("passed", "failed", "n", r4(F.col("passes")).alias("passes"), r4(F.col("fails")).alias("fails"))


@query("mean_answer_chances")
def mean_answer_chances(spark, sf):
    h = _history(spark, sf).withColumn("n", F.explode(F.array(*[F.lit(n) for n in P.score_sizes(10, 1000)]))).withColumn(
        "threshold", F.lit(0.45)).withColumn("higher_passes", F.lit(True))
    return P.mean_answer_chance(h, 0.95).select("entry_id", "label", "n", r4(F.col("passes")).alias("passes"), r4(F.col("fails")).alias("fails"))


_RATE = "(SELECT sum(exp(lgamma(passed+failed+2)-lgamma(i+1)-lgamma(passed+failed+2-i)+i*ln(0.8)+(passed+failed+1-i)*ln(0.2))) FROM generate_series(0, passed) g(i))"


@query("rates_at_least", f"SELECT entry_id, label, round({_RATE}, 4) AS likely FROM hist", ["hist"])
def rates_at_least(spark, sf):
    return _history(spark, sf).select("entry_id", "label", r4(P.rate_at_least(F.col("passed"), F.col("failed"), F.lit(0.8))).alias("likely"))


_CURVE_SQL = f"""{_CH_SQL},
cks AS (SELECT e.test_set_id AS scope_id, h.label, h.passed, h.failed FROM hist h JOIN entries e USING (entry_id) WHERE h.label <> 'N'),
curve AS (SELECT scope_id, n, exp(sum(ln(greatest(passes + fails, 1e-300)))) AS chance FROM cks JOIN ch USING (passed, failed) GROUP BY 1, 2),
rc AS (SELECT scope_id, min(n) FILTER (WHERE chance >= 0.9) AS reaches FROM curve GROUP BY 1),
best AS (SELECT c.scope_id, r.reaches, max(chance) AS best_chance FROM curve c JOIN rc r USING (scope_id) WHERE r.reaches IS NULL OR c.n <= r.reaches GROUP BY 1, 2),
pl AS (SELECT b.scope_id, b.reaches, b.best_chance, CASE WHEN b.reaches IS NULL THEN min(c.n) FILTER (WHERE c.chance >= b.best_chance - 0.05) END AS worth FROM best b JOIN curve c USING (scope_id) GROUP BY 1, 2, 3)"""


def _chances(spark, sf, checks, *targets, confidence=0.95):
    return kept(P.answer_chance(checks, _peaks(spark, *targets, confidence=confidence)), "chances")


@query("odds_curves", f"WITH {_CURVE_SQL} SELECT scope_id, CAST(n AS INTEGER) AS n, round(chance, 4) AS chance FROM curve", ["hist", "entries"])
def odds_curves(spark, sf):
    checks = _checks(spark, sf)
    return P.odds_curve(checks, _chances(spark, sf, checks, 0.8)).withColumn("chance", r4(F.col("chance")))


@query("batch_plans", f"WITH {_CURVE_SQL} SELECT scope_id, CAST(reaches AS INTEGER) AS reaches, round(best_chance, 4) AS best_chance, CAST(worth AS INTEGER) AS worth, CAST(coalesce(reaches, worth) AS INTEGER) AS times FROM pl", ["hist", "entries"])
def batch_plans(spark, sf):
    checks = _checks(spark, sf)
    return P.plan(P.odds_curve(checks, _chances(spark, sf, checks, 0.8))).select("scope_id", "reaches", r4(F.col("best_chance")).alias("best_chance"), "worth", "times")


@query("outcome_splits", f"""WITH {_CURVE_SQL},
s AS (SELECT p.scope_id, coalesce(p.reaches, p.worth) AS n FROM pl p)
SELECT s.scope_id, CAST(s.n AS INTEGER) AS n, round(exp(sum(ln(greatest(passes, 1e-300)))), 4) AS passed, round(1 - exp(sum(ln(greatest(1 - fails, 1e-300)))), 4) AS failed
FROM s JOIN cks USING (scope_id) JOIN ch ON ch.passed = cks.passed AND ch.failed = cks.failed AND ch.n = s.n GROUP BY 1, 2""", ["hist", "entries"])
def outcome_splits(spark, sf):
    return _split(spark, sf).select("scope_id", "n", r4(F.col("passed")).alias("passed"), r4(F.col("failed")).alias("failed"))


def _split(spark, sf):
    checks = _checks(spark, sf)
    chances = _chances(spark, sf, checks, 0.8)
    return P.outcome_split(checks, chances, P.plan(P.odds_curve(checks, chances)))


@query("likely_undecided_checks")
def likely_undecided_checks(spark, sf):
    return _split(spark, sf).select("scope_id", r4(F.col("inconclusive")).alias("inconclusive"), "likely_undecided")


@query("check_outlooks", f"""SELECT entry_id, label, CASE WHEN label = 'N' THEN 'certain' WHEN {_RATE} >= 0.9 THEN 'likely_pass' WHEN {_RATE} <= 0.1 THEN 'likely_fail' ELSE 'too_close' END AS outlook FROM hist""", ["hist"])
def check_outlooks(spark, sf):
    return P.outlook(_targeted(spark, sf)).select("entry_id", "label", "outlook")


@query("cheaper_options")
def cheaper_options(spark, sf):
    checks = _checks(spark, sf)
    shapes = checks.select("passed", "failed", F.explode(F.array(*[F.lit(t) for t in (0.8, 0.75, 0.7, 0.65)])).alias("target")).distinct()
    chances = _chances(spark, sf, shapes, 0.8, 0.75, 0.7, 0.65)
    planned = P.plan(P.odds_curve(checks, chances))
    lower = P.less_sure(0.95, 0.8)
    less = P.less_sure_options(checks, _chances(spark, sf, checks, 0.8, confidence=lower), planned, lower)
    options = P.cheaper_options(checks, chances, planned).unionByName(less, allowMissingColumns=True)
    return options.withColumn("best_chance", r4(F.col("best_chance"))).withColumn("chance", r4(F.col("chance")))


@query("fewest_left_out", f"""WITH {_CURVE_SQL},
al AS (SELECT passed, failed, max(passes + fails) AS alone FROM ch GROUP BY 1, 2),
o AS (SELECT c.scope_id, c.passed, c.failed, row_number() OVER (PARTITION BY scope_id ORDER BY alone DESC, c.passed DESC, c.failed DESC, label) AS k, count(*) OVER (PARTITION BY scope_id) AS total FROM cks c JOIN al USING (passed, failed)),
run AS (SELECT o.scope_id, ch.n, o.k, o.total, sum(ln(greatest(passes + fails, 1e-300))) OVER (PARTITION BY o.scope_id, ch.n ORDER BY k) AS lg FROM o JOIN ch USING (passed, failed)),
ways AS (SELECT scope_id, total - k AS left_out, n FROM run WHERE lg >= ln(0.9)
  UNION ALL SELECT scope_id, max(total), (SELECT min(n) FROM ch) FROM o WHERE scope_id IN (SELECT test_set_id FROM hist JOIN entries USING (entry_id) WHERE label = 'N') GROUP BY 1)
SELECT scope_id, min(left_out) AS left_out, CAST(min_by(n, left_out * 100000 + n) AS INTEGER) AS times FROM ways GROUP BY 1 HAVING min(left_out) > 0""", ["hist", "entries"])
def fewest_left_out(spark, sf):
    checks = _checks(spark, sf)
    return P.fewest_left_out(checks, _chances(spark, sf, checks, 0.8))


view("scoped", "SELECT 'test_set' AS scope_kind, test_set_id AS scope_id, * FROM entries UNION ALL SELECT 'test_plan', plan_id, * FROM entries", ["entries"])


def _scoped(spark, sf):
    links = world.table(spark, sf, "nation").select(F.col("n_nationkey").alias("test_set_id"), F.col("n_regionkey").alias("plan_id"))
    return P.resolve_scope(world.entries(spark, sf), links)


@query("resolved_scopes", "SELECT scope_kind, scope_id, entry_id, name FROM scoped", ["scoped"])
def resolved_scopes(spark, sf):
    return _scoped(spark, sf).select("scope_kind", "scope_id", "entry_id", "name")


@query("batch_costs", """
SELECT scope_kind, scope_id, r AS runs_per_time, a AS application_per_time, r AS judge_per_time, t AS times, CASE WHEN r * t > 10000 THEN 'too_many_runs' END AS problem, t * r AS runs_total, t * a AS application_total, t * r AS judge_total
FROM (SELECT scope_kind, scope_id, count(*) AS r, count(*) FILTER (WHERE model_output IS NULL) AS a, 600::BIGINT AS t FROM scoped GROUP BY 1, 2)""", ["scoped"])
def batch_costs(spark, sf):
    return P.estimate_cost(_scoped(spark, sf), check_types(spark), 600)


@query("scope_warnings", """
SELECT scope_kind, scope_id, 'recorded_answers' AS code, count(*) AS count FROM scoped WHERE model_output IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT scope_kind, scope_id, 'checks_not_applicable', 2 * count(*) FROM scoped GROUP BY 1, 2""", ["scoped"])
def scope_warnings(spark, sf):
    return P.scope_warnings(_scoped(spark, sf), check_types(spark), "one_sample_t")


@query("runs_for_mean_differences")
def runs_for_mean_differences(spark, sf):
    m = B.score_moments(world.plain_results(spark, sf))
    return m.select(*B.KEYS, B.runs_for_mean(F.col("sd"), F.abs(F.col("mean") - 0.45), 0.95).alias("runs"))


