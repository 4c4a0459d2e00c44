"""Tails and quantiles against published values and exact sums."""
import math

import pytest
from pyspark.sql import functions as F

from proofmill.functions import numeric as N


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, rows, schema, column):
    return [r["v"] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_binomial_tails_match_exact_sums(spark):
    rows = [(k, n, p) for n in (1, 3, 20, 29, 142, 1000) for p in (0.5, 0.8, 0.9, 0.999)
            for k in sorted({0, 1, n // 3, n // 2, (9 * n) // 10, n - 1, n})]
    frame = spark.createDataFrame([(float(k), float(n), p) for k, n, p in rows], "k double, n double, p double")
    got = frame.select(N.at_least(F.col("k"), F.col("n"), F.col("p")).alias("hi"),
                       N.at_most(F.col("k"), F.col("n"), F.col("p")).alias("lo")).collect()
    for (k, n, p), row in zip(rows, got, strict=True):
        pmf = [math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert row["hi"] == pytest.approx(math.fsum(pmf[k:]), abs=1e-9), (k, n, p)
        assert row["lo"] == pytest.approx(math.fsum(pmf[:k + 1]), abs=1e-9), (k, n, p)


def test_bounds(spark):
    rows = [(18, 20), (27, 29), (3, 7), (29, 29), (0, 5)]
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "k double, n double")
    got = frame.select(N.rate_lower(F.col("k"), F.col("n"), 0.95).alias("low"),
                       N.rate_upper(F.col("k"), F.col("n"), 0.95).alias("high")).collect()
    for (k, n), row in zip(rows, got, strict=True):
        if 0 < k < n:
            low, high = row["low"], row["high"]
            tail = math.fsum(math.comb(n, i) * low ** i * (1 - low) ** (n - i) for i in range(k, n + 1))
            assert tail == pytest.approx(0.05, abs=1e-9)
            tail = math.fsum(math.comb(n, i) * high ** i * (1 - high) ** (n - i) for i in range(k + 1))
            assert tail == pytest.approx(0.05, abs=1e-9)
    assert got[3]["low"] == pytest.approx(0.9019, abs=1e-4)
    assert got[3]["high"] == 1.0 and got[4]["low"] == 0.0


def test_counts_far_beyond_a_batch(spark):
    n = 4e9
    sd = math.sqrt(0.9 * 0.1 / n)
    got = one(spark, N.at_least(n * (0.9 + 1.6448536 * sd), n, 0.9))
    assert got == pytest.approx(0.05, abs=1e-4)


def test_student_t(spark):
    assert one(spark, N.t_above(2.970846888, 9.0)) == pytest.approx(0.007840424, abs=1e-8)
    for p, df, t in ((0.975, 19, 2.0930240544), (0.975, 1, 12.7062047364), (0.975, 1000, 1.9623390808),
                     (0.95, 9, 1.8331129327)):
        assert one(spark, N.t_quantile(p, float(df))) == pytest.approx(t, abs=1e-6)
    # df 1.5: P(T >= 1) by fine integration over the angle
    steps, df = 400_000, 1.5
    lo = math.atan(1 / math.sqrt(df))
    def area(a, b):
        h = (b - a) / steps
        return h * math.fsum(math.cos(a + (i + 0.5) * h) ** (df - 1) for i in range(steps))
    exact = area(lo, math.pi / 2) / area(-math.pi / 2, math.pi / 2)
    assert one(spark, N.t_above(1.0, df)) == pytest.approx(exact, abs=1e-6)


def test_chi_square_and_normal(spark):
    assert one(spark, N.chi_square_above(13.0316742, 1.0)) == pytest.approx(0.00030626663, abs=1e-9)
    for z in (-2.5, 0.0, 0.3, 1.96, 5.0):
        assert one(spark, N.normal_above(z)) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-10)
    # even degrees of freedom have a finite Poisson sum
    for x, df in ((3.0, 4), (25.0, 20), (900.0, 1000)):
        m = x / 2
        exact = math.fsum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(df // 2))
        assert one(spark, N.chi_square_above(x, float(df))) == pytest.approx(exact, abs=1e-9)
