"""Batch O against batch F of the lineitem results, check by check."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions.numeric import r4
from proofmill.operators import batch as B
from proofmill.operators import comparisons as C

from . import world
from .registry import query, view
from .batches import t_tail_sql

SURE = 0.95
view("sides", """
SELECT 'O-F' AS pair_id, coalesce(a.entry_id, b.entry_id) AS entry_id, coalesce(a.label, b.label) AS label,
  a.evaluated AS na, a.passed AS ka, b.evaluated AS nb, b.passed AS kb, a.passed::DOUBLE / a.evaluated AS ra,
  b.passed::DOUBLE / b.evaluated AS rb
FROM (SELECT * FROM plain_fold WHERE batch_id = 'F') a JOIN (SELECT * FROM plain_fold WHERE batch_id = 'O') b
  ON a.entry_id = b.entry_id AND a.label = b.label""", ["plain_fold"])


def _nc(z: str) -> str:
    def w(k, n, sign):
        r = f"({k}::DOUBLE / {n})"
        return (f"(({r} + {z}*{z}/(2.0*{n})) {sign} {z}*sqrt({r}*(1-{r})/{n} + {z}*{z}/(4.0*{n}*{n})))/(1+{z}*{z}/{n})")
    lo = lambda k, n: f"greatest(0.0, {w(k, n, '-')})"
    hi = lambda k, n: f"least(1.0, {w(k, n, '+')})"
    return f"""SELECT *, rb - ra AS difference,
  greatest(-1.0, rb - ra - sqrt(pow(rb - {lo('kb', 'nb')}, 2) + pow({hi('ka', 'na')} - ra, 2))) AS lower,
  least(1.0, rb - ra + sqrt(pow({hi('kb', 'nb')} - rb, 2) + pow(ra - {lo('ka', 'na')}, 2))) AS upper FROM sides"""


Z95, Z90, ZP = "1.959963984540054", "1.6448536269514722", "0.8416212335729143"


def _sides(spark, sf, frame):
    keyed = frame.withColumn("pair_id", F.lit("O-F"))
    a = keyed.filter("batch_id = 'F'").drop("batch_id")
    b = keyed.filter("batch_id = 'O'").drop("batch_id")
    return C.match_batches(a, b)


def _rates(spark, sf):
    return _sides(spark, sf, B.fold_results(world.plain_results(spark, sf)))


_UNEVEN = """
ea AS (SELECT DISTINCT l_suppkey AS entry_id, l_returnflag || '-' || CAST(l_quantity AS INTEGER) AS label FROM lineitem WHERE l_linestatus = 'F'),
eb AS (SELECT DISTINCT l_suppkey AS entry_id, l_returnflag || '-' || CAST(l_quantity AS INTEGER) AS label FROM lineitem WHERE l_linestatus = 'O')"""


def _uneven(spark, sf):
    li = world.table(spark, sf, "lineitem")
    side = lambda s: li.filter(F.col("l_linestatus") == s).select(
        F.lit("O-F").alias("pair_id"), F.col("l_suppkey").alias("entry_id"), F.concat_ws("-", "l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("label")).distinct()
    return C.match_batches(side("F"), side("O"))


@query("matched_checks", f"""WITH {_UNEVEN},
m AS (SELECT coalesce(ea.entry_id, eb.entry_id) AS entry_id, coalesce(ea.label, eb.label) AS label,
  CASE WHEN eb.label IS NULL THEN 'a' WHEN ea.label IS NULL THEN 'b' END AS only_in
  FROM ea FULL OUTER JOIN eb ON ea.entry_id = eb.entry_id AND ea.label = eb.label)
SELECT 'O-F' AS pair_id, entry_id, label, only_in, only_in IS NOT NULL AND NOT (entry_id IN (SELECT entry_id FROM ea)
  AND entry_id IN (SELECT entry_id FROM eb)) AS entry_missing FROM m""")
def matched_checks(spark, sf):
    return _uneven(spark, sf)


@query("unmatched_checks", f"""WITH {_UNEVEN}
SELECT 'O-F' AS pair_id, entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM eb) THEN label END AS label, 'a' AS only_in
FROM ea WHERE NOT EXISTS (SELECT 1 FROM eb WHERE eb.entry_id = ea.entry_id AND eb.label = ea.label)
UNION SELECT 'O-F', entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM ea) THEN label END, 'b'
FROM eb WHERE NOT EXISTS (SELECT 1 FROM ea WHERE eb.entry_id = ea.entry_id AND eb.label = ea.label)""")
def unmatched_checks(spark, sf):
    return C.unmatched(_uneven(spark, sf))


@query("pass_rate_comparison", f"""
SELECT entry_id, label, round(difference, 4) AS difference, round(lower, 4) AS lower, round(upper, 4) AS upper,
  CASE WHEN lower > 0 THEN 'better' WHEN upper < 0 THEN 'worse' ELSE 'no_difference' END AS verdict,
  CASE WHEN lower <= 0 AND upper >= 0 AND ra <> rb THEN CAST(greatest(2, ceil(pow({Z95} * sqrt(2 * (ra + rb) / 2 * (1 - (ra + rb) / 2))
    + {ZP} * sqrt(ra * (1 - ra) + rb * (1 - rb)), 2) / pow(ra - rb, 2))) AS BIGINT) END AS times_to_decide
FROM ({_nc(Z95)})""", ["sides"])
def pass_rate_comparison(spark, sf):
    return C.compare_pass_rates(_rates(spark, sf), SURE).select(
        "entry_id", "label", *[r4(F.col(x)).alias(x) for x in ("difference", "lower", "upper")], "verdict", "times_to_decide")


@query("two_by_two_tests", f"""
WITH t AS (SELECT entry_id, label, ka AS a, na - ka AS b, kb AS c, nb - kb AS d, na + nb AS n, ka + kb = 0 OR ka + kb = na + nb AS plain FROM sides)
SELECT entry_id, label, CASE WHEN plain THEN 0.0 ELSE round(n * pow(1.0 * a * d - 1.0 * b * c, 2) / (1.0 * (a + b) * (c + d) * (a + c) * (b + d)), 4) END AS chi_square,
  round(least(a + b, c + d)::DOUBLE * least(a + c, b + d) / n, 4) AS min_expected,
  CASE WHEN plain THEN 1.0 ELSE round((SELECT sum(exp(lp)) FROM (SELECT lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(n+1)-lgamma(x+1)-lgamma(a+b-x+1)-lgamma(a+c-x+1)-lgamma(c+d-a-c+x+1) AS lp
      FROM generate_series(greatest(0, a + c - c - d), least(a + b, a + c)) g(x))
    WHERE lp <= lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(n+1)-lgamma(a+1)-lgamma(b+1)-lgamma(c+1)-lgamma(d+1) + 1e-7), 4) END AS p_fisher
FROM t""", ["sides"])
def two_by_two_tests(spark, sf):
    """Checks of both batches; where all or none passed nothing differs."""
    m = _rates(spark, sf).filter("only_in is null")
    ka, na, kb, nb = (F.col(x) for x in ("passed_a", "evaluated_a", "passed_b", "evaluated_b"))
    out = C.two_by_two(m, ka, na - ka, kb, nb - kb)
    return out.select("entry_id", "label", *[r4(F.col(x)).alias(x) for x in ("chi_square", "min_expected", "p_fisher")])


@query("shown_p_values")
def shown_p_values(spark, sf):
    return C.compare_pass_rates(_rates(spark, sf), SURE).select("entry_id", "label", r4(F.col("p_value")).alias("p_value"),
                                                             "p_value_method")


@query("no_worse_comparison", f"""
SELECT entry_id, label, round(lower, 4) AS lower, round(upper, 4) AS upper,
  CASE WHEN lower > -0.05 THEN 'no_worse' WHEN upper < -0.05 THEN 'worse' ELSE 'inconclusive' END AS verdict,
  CASE WHEN lower <= -0.05 AND upper >= -0.05 AND rb - ra + 0.05 > 0 THEN CASE WHEN ra * (1 - ra) + rb * (1 - rb) = 0 THEN 2 ELSE
    CAST(greatest(2, ceil(pow({Z90} + {ZP}, 2) * (ra * (1 - ra) + rb * (1 - rb)) / pow(rb - ra + 0.05, 2))) AS BIGINT) END END AS times_to_decide
FROM ({_nc(Z90)})""", ["sides"])
def no_worse_comparison(spark, sf):
    return C.compare_no_worse(_rates(spark, sf), 0.05, SURE).select(
        "entry_id", "label", *[r4(F.col(x)).alias(x) for x in ("lower", "upper")], "verdict", "times_to_decide")


_WELCH = f"""
m AS (SELECT batch_id, entry_id, label, count(*) AS n, avg(score) AS mean, var_samp(score) / count(*) AS v FROM results
  WHERE NOT errored GROUP BY 1, 2, 3),
w AS (SELECT a.entry_id, a.label, b.mean - a.mean AS difference, a.v + b.v AS se2, a.n AS n_a, b.n AS n_b,
  pow(a.v + b.v, 2) / (a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1)) AS df, (b.mean - a.mean) / sqrt(a.v + b.v) AS t,
  greatest(sqrt(a.v * a.n), sqrt(b.v * b.n)) AS spread
  FROM m a JOIN m b ON a.entry_id = b.entry_id AND a.label = b.label AND a.batch_id = 'F' AND b.batch_id = 'O'),
p AS (SELECT *, 2 * {t_tail_sql('abs(t)', 'df')} AS p_value FROM w)"""


def _score_sides(spark, sf):
    return _sides(spark, sf, B.score_moments(world.plain_results(spark, sf))).withColumn("higher_passes", F.lit(True))


@query("mean_score_comparison", f"""WITH {_WELCH}
SELECT entry_id, label, round(difference, 9) AS difference, round(df, 4) AS df, round(t, 4) AS t, round(p_value, 4) AS p_value,
  CASE WHEN p_value < 0.05 THEN CASE WHEN difference > 0 THEN 'better' ELSE 'worse' END ELSE 'no_difference' END AS verdict
FROM p""", ["results"])
def mean_score_comparison(spark, sf):
    return C.compare_means(_score_sides(spark, sf), SURE, bounds=False).select(
        "entry_id", "label", F.round("difference", 9).alias("difference"),
        *[r4(F.col(x)).alias(x) for x in ("df", "t", "p_value")], "verdict")


@query("mean_difference_bounds")
def mean_difference_bounds(spark, sf):
    return C.compare_means(_score_sides(spark, sf), SURE).select(
        "entry_id", "label", *[r4(F.col(x)).alias(x) for x in ("lower", "upper")])


@query("runs_for_mean_gap", f"""WITH {_WELCH}
SELECT entry_id, label, CASE WHEN abs(difference) > 1e-12 THEN CAST(greatest(2, ceil(2 * pow(({Z95} + {ZP}) * spread / abs(difference), 2))) AS BIGINT) END AS runs
FROM w""", ["results"])
def runs_for_mean_gap(spark, sf):
    gap = F.when(F.abs(F.col("mean_b") - F.col("mean_a")) > 1e-12, F.col("mean_b") - F.col("mean_a")).otherwise(0.0)
    runs = C.runs_for_means(F.greatest("sd_a", "sd_b"), gap, SURE)
    return _score_sides(spark, sf).select("entry_id", "label", runs.alias("runs"))


_NORMAL_TAIL = ("(SELECT sum(exp(-0.5 * pow(z + (12.0 * i / 4000.0), 2)) * CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
                " * (12.0 / 4000.0) / 3 / sqrt(2 * pi()) FROM generate_series(0, 4000) g(i))")


@query("rank_comparison", f"""
WITH s AS (SELECT entry_id, label, batch_id, score FROM results WHERE NOT errored),
r AS (SELECT *, rank() OVER (PARTITION BY entry_id, label ORDER BY score) + (count(*) OVER (PARTITION BY entry_id, label, score) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY entry_id, label, score) AS tie FROM s),
g AS (SELECT entry_id, label, count(*) FILTER (WHERE batch_id = 'F')::DOUBLE AS na, count(*) FILTER (WHERE batch_id = 'O')::DOUBLE AS nb,
  sum(rk) FILTER (WHERE batch_id = 'O') AS rb, sum(tie::DOUBLE * tie - 1) AS ties FROM r GROUP BY 1, 2),
u AS (SELECT *, rb - nb * (nb + 1) / 2 AS u_b FROM g),
v AS (SELECT *, (greatest(u_b, na * nb - u_b) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS z FROM u),
p AS (SELECT *, least(1.0, 2 * CASE WHEN z >= 0 THEN {_NORMAL_TAIL} ELSE 1.0 END) AS p_value FROM v)
SELECT entry_id, label, u_b, round(u_b / (na * nb), 6) AS effect, round(p_value, 4) AS p_value,
  CASE WHEN p_value <= 0.05 AND u_b / (na * nb) <> 0.5 THEN CASE WHEN u_b / (na * nb) > 0.5 THEN 'better' ELSE 'worse' END ELSE 'no_difference' END AS verdict
FROM p""", ["results"])
def rank_comparison(spark, sf):
    scores = (B.scored(world.plain_results(spark, sf)).withColumn("higher_passes", F.lit(True))
              .withColumn("side", F.when(F.col("batch_id") == "F", "a").otherwise("b")))
    return C.compare_ranks(scores, ["entry_id", "label"], SURE).select(
        "entry_id", "label", "u_b", F.round("effect", 6).alias("effect"), r4(F.col("p_value")).alias("p_value"), "verdict")


@query("paired_comparison", f"""
WITH d AS (SELECT rb - ra AS d FROM sides),
b AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY abs(d)) AS tie FROM d WHERE d <> 0),
s AS (SELECT count(*)::DOUBLE AS m, least(sum(rk) FILTER (WHERE d > 0), sum(rk) FILTER (WHERE d < 0)) AS w, sum(tie::DOUBLE * tie - 1) AS ties FROM r),
z0 AS (SELECT *, abs((w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)) AS z, mean / (sd / sqrt(n)) AS t FROM b, s)
SELECT 'O-F' AS pair_id, n AS n_pairs, round(mean, 6) AS difference, round(t, 4) AS t,
  round(2 * {t_tail_sql('abs(t)', '(n - 1)')}, 4) AS p_value, w AS statistic
FROM z0""", ["sides"])
def paired_comparison(spark, sf):
    return _paired(spark, sf).select(
        "pair_id", "n_pairs", F.round("difference", 6).alias("difference"), r4(F.col("t")).alias("t"),
        r4(F.col("p_value")).alias("p_value"), "statistic")


def _paired(spark, sf):
    pairs = C.newcombe(_rates(spark, sf), SURE).filter("only_in is null").select("pair_id", "rate_a", "rate_b")
    return C.compare_paired(pairs, ["pair_id"], SURE)


@query("paired_rank_test")
def paired_rank_test(spark, sf):
    # exact or normal, by how many pairs there are
    return _paired(spark, sf).select("pair_id", r4(F.col("p_wilcoxon")).alias("p_wilcoxon"), "wilcoxon_method", "verdict", "agrees")


@query("comparison_outcomes", f"""
WITH v AS (SELECT entry_id, CASE WHEN lower > 0 THEN 'better' WHEN upper < 0 THEN 'worse' ELSE 'no_difference' END AS verdict FROM ({_nc(Z95)}))
SELECT entry_id, count(*) FILTER (WHERE verdict = 'better') AS n_better, count(*) FILTER (WHERE verdict = 'worse') AS n_worse,
  count(*) FILTER (WHERE verdict = 'no_difference') AS n_no_difference, 0::BIGINT AS n_no_worse, 0::BIGINT AS n_inconclusive, 0::BIGINT AS n_none,
  CASE WHEN count(*) FILTER (WHERE verdict = 'worse') > 0 THEN 'worse' WHEN count(*) FILTER (WHERE verdict = 'better') > 0 THEN 'better'
       ELSE 'no_difference' END AS outcome FROM v GROUP BY 1""", ["sides"])
def comparison_outcomes(spark, sf):
    return C.comparison_outcome(C.compare_pass_rates(_rates(spark, sf), SURE), ["entry_id"])


@query("comparable_batches", """
WITH y AS (SELECT *, CAST(split_part(batch_id, '-', 3) AS INTEGER) AS yr FROM sbatches),
c AS (SELECT DISTINCT batch_id, quarter(created_at) AS q FROM sruns WHERE batch_id IS NOT NULL),
k AS (SELECT batch_id, string_agg(q::VARCHAR, ',' ORDER BY q) AS qs FROM c GROUP BY 1)
SELECT a.batch_id AS batch_a, b.batch_id AS batch_b, CASE WHEN a.status = 'Running' OR b.status = 'Running' THEN 'not_finished'
  WHEN ka.qs <> kb.qs THEN 'content_differs' END AS refused
FROM y a JOIN y b ON b.scope_id = a.scope_id AND b.yr = a.yr + 1 JOIN k ka ON ka.batch_id = a.batch_id JOIN k kb ON kb.batch_id = b.batch_id""",
       ["sbatches", "sruns"])
def comparable_batches(spark, sf):
    batches = (world.scope_batches(spark, sf).withColumn("finished", F.col("status") != "Running")
               .withColumn("_yr", F.split("batch_id", "-")[2].cast("int")))
    pairs = batches.select(F.col("batch_id").alias("batch_a"), F.col("scope_id").alias("_s"), (F.col("_yr") + 1).alias("_y")).join(
        batches.select(F.col("batch_id").alias("batch_b"), F.col("scope_id").alias("_s"), F.col("_yr").alias("_y")), ["_s", "_y"])
    contents = (world.scope_runs(spark, sf).filter("batch_id is not null")
                .select("batch_id", F.quarter("created_at").alias("entry_id"), F.lit("x").alias("content")).distinct())
    return C.comparable(pairs.select("batch_a", "batch_b"), batches.select("batch_id", "scope_id", "finished"), contents)
