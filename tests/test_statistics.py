"""Verdicts, comparisons and planning against published values."""
import math
import random

import pytest
from pyspark.sql import functions as F

from proofmill.operators import batch as B
from proofmill.operators import comparisons as C
from proofmill.operators import planning as P
from proofmill.operators import sequential as Q

SCORES = [0.61, 0.72, 0.55, 0.8, 0.67, 0.7, 0.64, 0.59, 0.77, 0.69]


def folded(spark, pairs):
    rows = [("b", i, "x", n, k, n - k, 0) for i, (k, n) in enumerate(pairs)]
    return spark.createDataFrame(rows, "batch_id string, entry_id int, label string, evaluated long, passed long, failed long, errored long")


def test_gate_verdicts(spark):
    want = {(29, 29): "pass", (28, 29): "inconclusive", (23, 29): "inconclusive", (18, 20): "inconclusive",
            (20, 20): "inconclusive", (22, 29): "fail", (0, 3): "fail"}
    got = B.gate(folded(spark, list(want)), 0.9, 0.95).collect()
    assert {(r["passed"], r["evaluated"]): r["verdict"] for r in got} == want


def test_verdict_agrees_with_the_exact_bound(spark):
    pairs = [(k, n) for n in (5, 29, 46, 60) for k in range(n + 1)]
    out = B.exact_bounds(B.gate(folded(spark, pairs), 0.9, 0.95), 0.95).collect()
    assert len(out) == len(pairs)
    for r in out:
        assert (r["verdict"] == "pass") == (r["lower"] >= 0.9 - 1e-12), r
        if r["verdict"] == "fail":
            assert r["upper"] <= 0.9 + 1e-12


def test_rules_floors_and_runs_to_decide(spark):
    sizes = spark.createDataFrame([(29,), (46,), (20,), (1,)], "n int")
    got = {r["n"]: (r["r"]["pass_at_least"], r["r"]["fail_at_most"])
           for r in sizes.withColumn("r", B.gate_rule(F.col("n"), F.lit(0.9), 0.95)).collect()}
    assert got == {29: (29, 22), 46: (45, 37), 20: (None, 15), 1: (None, None)}
    floors = spark.createDataFrame([(0.8,), (0.9,), (0.95,), (0.99,)], "t double").select(B.gate_floor(F.col("t"), 0.95).alias("f"))
    assert [r["f"] for r in floors.collect()] == [14, 29, 59, 299]
    gated = B.gate(folded(spark, [(27, 29), (28, 29), (28, 28)]), 0.9, 0.95).withColumn("target", F.lit(0.9))
    rules = B.gate_rules(gated.select("target"), 0.95, 300)
    got = {(r["passed"], r["evaluated"]): r["times_to_decide"] for r in B.runs_to_decide(gated, rules).collect()}
    assert got == {(27, 29): 239, (28, 29): 61, (28, 28): 29}


def scores(spark, values, **more):
    rows = [("b", 1, "x", float(v), False) for v in values]
    return spark.createDataFrame(rows, "batch_id string, entry_id int, label string, score double, errored boolean")


def test_mean_against_threshold(spark):
    base = B.score_moments(scores(spark, SCORES)).withColumn("threshold", F.lit(0.6)).withColumn("higher_passes", F.lit(True))
    r = B.one_sample_t(base, 0.95).first()
    assert r["t"] == pytest.approx(2.970846888, abs=1e-8)
    assert r["p_pass"] == pytest.approx(0.007840424, abs=1e-8)
    assert (r["lower"], r["upper"]) == pytest.approx((0.62833950, 0.71966050), abs=1e-7)
    flat = B.score_moments(scores(spark, [0.7] * 5)).withColumn("threshold", F.lit(0.7)).withColumn("higher_passes", F.lit(True))
    assert B.one_sample_t(flat, 0.95).first()["verdict"] == "pass"
    single = B.score_moments(scores(spark, [0.9])).withColumn("threshold", F.lit(0.1)).withColumn("higher_passes", F.lit(True))
    assert B.one_sample_t(single, 0.95).first()["verdict"] == "inconclusive"


def test_summary_of_four_scores(spark):
    r = B.score_summary(scores(spark, [0.2, 0.4, 0.5, 0.9])).first()
    assert (r["median"], r["p10"]) == pytest.approx((0.45, 0.26))
    assert r["sd"] == pytest.approx(0.29439202888)


def test_two_by_two_and_newcombe(spark):
    t = spark.createDataFrame([(10, 2, 3, 15), (8, 2, 1, 5)], "a int, b int, c int, d int")
    got = {r["a"]: r for r in C.two_by_two(t, F.col("a"), F.col("b"), F.col("c"), F.col("d")).collect()}
    assert got[10]["chi_square"] == pytest.approx(13.0316742) and got[10]["p_chi_square"] == pytest.approx(0.00030626663, rel=1e-6)
    assert got[8]["p_fisher"] == pytest.approx(0.034965034965)
    m = spark.createDataFrame([(40, 50, 45, 50), (56, 70, 48, 80)], "passed_a int, evaluated_a int, passed_b int, evaluated_b int")
    got = {r["passed_a"]: r for r in C.newcombe(m, 0.95).collect()}
    assert (got[40]["lower"], got[40]["upper"]) == pytest.approx((-0.0434317859, 0.2420971578))
    assert (-got[56]["upper"], -got[56]["lower"]) == pytest.approx((0.0524, 0.3339), abs=1e-4)


def test_exact_p_of_any_size(spark):
    from math import comb
    import time
    tables = [(a, b, c, d) for a in (0, 1, 3, 9) for b in (0, 2, 7) for c in (0, 1, 5) for d in (1, 4, 12)]
    big = [(10**9, 10**9, 10**9, 10**9), (10**9 + 10**5, 10**9, 10**9, 10**9 + 10**5), (5 * 10**8, 10**9, 10**9, 10**9), (3, 10**9, 10, 10**9)]
    df = spark.createDataFrame(tables + big, "a long, b long, c long, d long")
    start = time.time()
    got = {(r.a, r.b, r.c, r.d): r.p_fisher for r in C.two_by_two(df, *map(F.col, "abcd")).collect()}
    assert time.time() - start < 60
    for a, b, c, d in tables:
        r1, r2, c1 = a + b, c + d, a + c
        chance = lambda x: comb(r1, x) * comb(r2, c1 - x)
        every = [chance(x) for x in range(max(0, c1 - r2), min(r1, c1) + 1)]
        want = sum(x for x in every if x <= chance(a)) / sum(every) if min(r1, r2, c1, b + d) else 1.0
        assert got[(a, b, c, d)] == pytest.approx(want, rel=1e-6), (a, b, c, d)
    assert got[big[0]] == 1.0 and got[big[2]] == 0.0
    assert 0 < got[big[1]] < 0.01 and 0.04 < got[big[3]] < 0.1


def rank(spark, a, b):
    rows = [("k", "a", float(v), True) for v in a] + [("k", "b", float(v), True) for v in b]
    return C.compare_ranks(spark.createDataFrame(rows, "k string, side string, score double, higher_passes boolean"), ["k"], 0.95).first()


def test_rank_tests(spark):
    r = rank(spark, [1.2, 3.4, 2.2, 5.1, 0.3], [4.4, 6.1, 5.5, 3.9, 7.0, 2.8])
    assert (r["method"], r["u_b"]) == ("exact", 26.0) and r["p_value"] == pytest.approx(0.05194805)
    r = rank(spark, [0.5] * 5 + [0.7] * 6, [0.7] * 8 + [0.9] * 4)
    assert (r["method"], r["u_b"]) == ("normal", 108.0) and r["p_value"] == pytest.approx(0.0033996068)


def test_paired_rank_test(spark):
    def run(ds):
        return C.compare_paired(spark.createDataFrame([("k", 0.0, d) for d in ds], "k string, rate_a double, rate_b double"), ["k"], 0.95).first()
    r = run([0.1, 0.05, -0.02, 0.08, 0.12, 0.03, 0.07, -0.04])
    assert (r["wilcoxon_method"], r["statistic"]) == ("exact", 4.0) and r["p_wilcoxon"] == pytest.approx(0.0546875)
    r = run([0.1, 0.1, -0.05, 0.2, 0.0, 0.1, 0.15, -0.1, 0.05, 0.3])
    assert (r["wilcoxon_method"], r["statistic"]) == ("normal", 6.0) and r["p_wilcoxon"] == pytest.approx(0.0483942, abs=1e-6)
    assert run([0.1] * 5)["verdict"] is None


def test_sample_sizes(spark):
    one = spark.range(1)
    assert one.select(B.runs_for_mean(F.lit(0.1), F.lit(0.05), 0.95).alias("n")).first()["n"] == 27
    assert one.select(C.runs_for_means(F.lit(0.1), F.lit(0.05), 0.95).alias("n")).first()["n"] == 63
    assert one.select(C.runs_for_rates(F.lit(0.8), F.lit(0.9), 0.95).alias("n")).first()["n"] == 199


def test_chance_of_an_answer(spark):
    history = spark.createDataFrame([(40, 0, 0.9), (38, 2, 0.9)], "passed long, failed long, target double")
    rules = B.gate_rules(history, 0.95, 240)
    got = {(r["passed"], r["n"]): r["answer"] for r in P.answer_chance(history, rules).collect()}
    for key, want in {(40, 29): 0.587, (40, 142): 0.907, (38, 179): 0.574, (38, 239): 0.629}.items():
        assert got[key] == pytest.approx(want, abs=1e-3)
    # by brute force at one size
    n, a, b = 179, 39, 3
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    pmf = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + beta(k + a, n - k + b) - beta(a, b)) for k in range(n + 1)]
    row = next(r for r in P.answer_chance(history, rules).collect() if r["passed"] == 38 and r["n"] == n)
    assert row["passes"] == pytest.approx(math.fsum(pmf[row["pass_at_least"]:]), abs=1e-9)
    assert row["fails"] == pytest.approx(math.fsum(pmf[:row["fail_at_most"] + 1]), abs=1e-9)


def test_cheaper_options_match_building_the_changed_scope_again(spark):
    checks = spark.createDataFrame([("s", "a", 50, 4, 0.8, False), ("s", "b", 44, 10, 0.8, False), ("s", "c", 30, 0, 0.8, False)],
                                   "scope_id string, label string, passed long, failed long, target double, certain boolean")
    rules = B.gate_rules(spark.createDataFrame([(t,) for t in (0.8, 0.75, 0.7, 0.65)], "target double"), 0.95, 200)
    grid = rules.join(P.sizes(rules).select("n").distinct(), "n")
    shapes = checks.select("passed", "failed").distinct().withColumn("target", F.explode(F.array(*[F.lit(t) for t in (0.8, 0.75, 0.7, 0.65)])))
    chances = P.answer_chance(shapes, grid).cache()
    planned = P.plan(P.odds_curve(checks, chances))
    got = P.cheaper_options(checks, chances, planned).collect()
    assert got
    for r in got:
        if r["kind"] == "leave_out":
            rest = checks.filter(F.col("passed") != r["passed"])
        else:
            rest = checks.withColumn("target", F.when(F.col("passed") == r["passed"], r["new_target"]).otherwise(F.col("target")))
        again = P.plan(P.odds_curve(rest, chances)).first()
        assert (again["reaches"], round(again["best_chance"], 9)) == (r["reaches"], round(r["best_chance"], 9))


def test_sequential_decision_matches_a_plain_loop(spark):
    rng = random.Random(5)
    looks, level, target = [10, 20, 35, 50], 0.98, 0.8
    rows = [("b", e, "x", i + 1, rng.random() < p) for e, p in enumerate((0.99, 0.8, 0.4, 0.7)) for i in range(50)]
    df = spark.createDataFrame(rows, "batch_id string, entry_id int, label string, batch_index int, passed boolean")
    plans = spark.createDataFrame([("b", looks, level, target)], "batch_id string, looks array<int>, level double, target double")
    got = {r["entry_id"]: (r["verdict"], r["at_time"], r["passes"], r["evaluated"]) for r in Q.decide(df, plans).collect()}
    for e in range(4):
        mine = [r for r in rows if r[1] == e]
        want = None
        for look in looks:
            n, k = look, sum(r[4] for r in mine if r[3] <= look)
            pmf = [math.comb(n, i) * target ** i * (1 - target) ** (n - i) for i in range(n + 1)]
            v = "pass" if sum(pmf[k:]) <= 1 - level else "fail" if sum(pmf[:k + 1]) <= 1 - level else None
            if v or look == looks[-1]:
                want = (v, look if v else None, k, n)
                break
        assert got[e] == want


def test_failures_by_entry(spark):
    df = spark.createDataFrame([("b", 1, 10, 2), ("b", 2, 3, 15)], "batch_id string, entry_id int, passed long, failed long")
    r = B.failures_by_entry(df, 0.95).first()
    assert r["chi_square"] == pytest.approx(13.0316742) and r["verdict"] == "concentrated"


def test_a_batch_with_nothing_decided(spark):
    f = folded(spark, [(0, 0)]).withColumn("stopped", F.lit(False)).withColumn("left_out", F.lit(False)).withColumn("target", F.lit(0.9))
    r = B.judge_checks(f, "binomial_gate", 0.95).first()
    assert r["no_verdict"] == "no_result" and r["verdict"] is None
