"""Two batches side by side: B against the baseline A, check by check."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import numeric as N
from ..schemas import POWER
from .keyed import running_before, spread

RANK_FLOOR = 4   # fewest scores on each side
PAIR_FLOOR = 6   # fewest pairs


# ── matching ─────────────────────────────────────────────────────────────────

def match_batches(a: DataFrame, b: DataFrame, keys: list[str] = ["pair_id"]) -> DataFrame:
    """Every (entry, label) of either side with both sides' columns and where
    it is: `only_in` null, 'a' or 'b', and whether the whole entry is missing
    there. Inputs carry the comparison's keys, entry_id and label."""
    on = [*keys, "entry_id", "label"]
    left = a.withColumnsRenamed({c: f"{c}_a" for c in a.columns if c not in on}).withColumn("_a", F.lit(True))
    right = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in on}).withColumn("_b", F.lit(True))
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    both = left.join(right, cond, "full_outer")
    for k in on:
        both = both.withColumn(k, F.when(F.col("_a").isNull(), F.col(f"_r_{k}")).otherwise(F.col(k)))
    both = both.drop(*[f"_r_{k}" for k in on])
    entry = W.partitionBy(*keys, "entry_id")
    return (both.withColumn("only_in", F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b"))
            .withColumn("entry_missing", F.col("only_in").isNotNull()
                        & ~(F.coalesce(F.bool_or("_a").over(entry), F.lit(False))
                            & F.coalesce(F.bool_or("_b").over(entry), F.lit(False))))
            .drop("_a", "_b"))


def unmatched(matched: DataFrame, keys: list[str] = ["pair_id"]) -> DataFrame:
    """What one side has alone: the entry once (label null) when the other
    batch lacks it, else each label."""
    return (matched.filter("only_in is not null")
            .select(*keys, "entry_id", F.when(~F.col("entry_missing"), F.col("label")).alias("label"), "only_in")
            .distinct())


# ── pass rates ───────────────────────────────────────────────────────────────

def newcombe(matched: DataFrame, confidence: float) -> DataFrame:
    """lower, difference and upper of rate B - rate A, from the two score intervals."""
    ka, na, kb, nb = (F.col(c) for c in ("passed_a", "evaluated_a", "passed_b", "evaluated_b"))
    out = (matched.withColumn("_wa", N.wilson(ka, na, confidence)).withColumn("_wb", N.wilson(kb, nb, confidence))
           .withColumn("rate_a", ka / F.nullif(na, F.lit(0))).withColumn("rate_b", kb / F.nullif(nb, F.lit(0))))
    square = lambda c: c * c
    low = F.sqrt(square(F.col("rate_b") - F.col("_wb.low")) + square(F.col("_wa.high") - F.col("rate_a")))
    high = F.sqrt(square(F.col("_wb.high") - F.col("rate_b")) + square(F.col("rate_a") - F.col("_wa.low")))
    return (out.withColumn("difference", F.col("rate_b") - F.col("rate_a"))
            .withColumn("lower", F.when(F.col("difference").isNotNull(), F.greatest(F.lit(-1.0), F.col("difference") - low)))
            .withColumn("upper", F.when(F.col("difference").isNotNull(), F.least(F.lit(1.0), F.col("difference") + high)))
            .drop("_wa", "_wb"))


def two_by_two(df: DataFrame, a: Column, b: Column, c: Column, d: Column) -> DataFrame:
    """Pearson's chi-square (no correction) and Fisher's exact p of the table
    [[a, b], [c, d]], and the smallest expected count.

    Fisher is asked only where a table is given whole: its cost is that of two
    tails, each summed until it adds nothing (`_fisher`).
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n, r1, r2, c1, c2 = a + b + c + d, a + b, c + d, a + c, b + d
    empty = (r1 == 0) | (r2 == 0) | (c1 == 0) | (c2 == 0)
    determinant = a * d - b * c
    chi = F.when(empty, 0.0).otherwise(n * determinant * determinant / (r1 * r2 * c1 * c2))
    out = (spread(df).withColumn("chi_square", chi)
           .withColumn("min_expected", F.when(n > 0, F.least(r1, r2) * F.least(c1, c2) / n).otherwise(0.0))
           .withColumn("p_chi_square", F.when(F.col("chi_square") == 0, 1.0)
                       .otherwise(N.chi_square_above(F.col("chi_square"), F.lit(1.0)))))

    # the table's own chance and, on the other side of the mode, the first one no larger
    state = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), c2.alias("c2"), n.alias("n"))
    return out.withColumn("p_fisher", F.when((n == 0) | empty, 1.0).otherwise(F.least(F.lit(1.0), _fisher(state))))


@F.pandas_udf(T.DoubleType())
def _fisher(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """Two-sided exact p: the chances of all tables no likelier than the seen
    one. From a table outward each chance is its neighbour's times a ratio that
    only falls, so a tail is summed in blocks until it adds nothing any more;
    where the other tail begins is found by bisection."""
    from math import exp, lgamma

    def tail(a, b, c, d):  # the sum of the tables from this one on, in shares of its own chance, a rising
        total, term = 1.0, 1.0
        while term > 1e-17 * total and b > 0 and c > 0:
            k = np.arange(min(4096.0, min(b, c)))
            steps = np.cumprod((b - k) * (c - k) / ((a + k + 1) * (d + k + 1)))
            total += term * float(steps.sum())
            term *= float(steps[-1])
            a, b, c, d = a + len(k), b - len(k), c - len(k), d + len(k)
        return total

    def log_p(a, r1, r2, c1):
        return -(lgamma(a + 1) + lgamma(r1 - a + 1) + lgamma(c1 - a + 1) + lgamma(r2 - c1 + a + 1))

    def one(a, b, c, d, r1, r2, c1, c2, n):
        if min(r1, r2, c1, c2) <= 0:
            return 1.0
        low, high = max(0.0, c1 - r2), min(r1, c1)
        mode = min(max(float(int((r1 + 1) * (c1 + 1) / (n + 2))), low), high)
        seen = log_p(a, r1, r2, c1)
        norm = lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(c2 + 1) - lgamma(n + 1)
        slack = 1e-7 + 4e-16 * abs(norm)
        if seen >= log_p(mode, r1, r2, c1) - slack:
            return 1.0
        up = a > mode
        # the table nearest to the mode on the other side that is no likelier
        near, far = mode, (low if up else high)
        other = None
        if log_p(far, r1, r2, c1) <= seen + slack:
            while abs(far - near) > 1:
                mid = float(int((far + near) / 2))
                near, far = (near, mid) if log_p(mid, r1, r2, c1) <= seen + slack else (mid, far)
            other = far
        def sum_from(x, rising):
            cells = (x, r1 - x, c1 - x, r2 - c1 + x)
            a_, b_, c_, d_ = cells if rising else (cells[1], cells[0], cells[3], cells[2])
            return exp(min(0.0, norm + log_p(x, r1, r2, c1))) * tail(a_, b_, c_, d_)
        return sum_from(a, up) + (sum_from(other, not up) if other is not None else 0.0)

    for rows in parts:
        yield pd.Series([one(*row) for row in rows.itertuples(index=False, name=None)], dtype="float64")


def compare_pass_rates(matched: DataFrame, confidence: float) -> DataFrame:
    """Better, worse or no difference, by the interval alone; the p-value
    shown beside it is chi-square's when every expected count reaches 5."""
    out = newcombe(matched, confidence)
    ka, na, kb, nb = (F.col(c) for c in ("passed_a", "evaluated_a", "passed_b", "evaluated_b"))
    out = two_by_two(out, ka, na - ka, kb, nb - kb)
    fisher = F.col("min_expected") < 5
    return (out.withColumn("verdict", F.when(F.col("lower").isNull(), None).when(F.col("lower") > 0, "better")
                           .when(F.col("upper") < 0, "worse").otherwise("no_difference"))
            .withColumn("p_value", F.when(fisher, F.col("p_fisher")).otherwise(F.col("p_chi_square")))
            .withColumn("p_value_method", F.when(fisher, "fisher_exact").otherwise("chi_square"))
            .withColumn("times_to_decide", F.when(F.col("verdict") == "no_difference",
                                                  runs_for_rates(F.col("rate_a"), F.col("rate_b"), confidence))))


def runs_for_rates(rate_a: Column, rate_b: Column, confidence: float, power: float = POWER) -> Column:
    """Runs per batch to see this difference of rates; null when equal."""
    z_a, z_b = N.z_value(1 - (1 - confidence) / 2), N.z_value(power)
    pooled = (rate_a + rate_b) / 2
    top = z_a * F.sqrt(2 * pooled * (1 - pooled)) + z_b * F.sqrt(rate_a * (1 - rate_a) + rate_b * (1 - rate_b))
    gap = rate_a - rate_b
    return F.when(gap != 0, F.greatest(F.lit(2), F.ceil(top * top / (gap * gap))).cast("long"))


def compare_no_worse(matched: DataFrame, margin: float, confidence: float) -> DataFrame:
    """Is B no worse than A by more than `margin`? One-sided bounds."""
    out = newcombe(matched, 2 * confidence - 1)
    gap = F.col("rate_b") - F.col("rate_a") + margin
    variance = F.col("rate_a") * (1 - F.col("rate_a")) + F.col("rate_b") * (1 - F.col("rate_b"))
    z = N.z_value(confidence) + N.z_value(POWER)
    needed = F.when(gap <= 0, None).when(variance == 0, 2).otherwise(
        F.greatest(F.lit(2), F.ceil(z * z * variance / (gap * gap)))).cast("long")
    return (out.withColumn("verdict", F.when(F.col("lower").isNull(), None).when(F.col("lower") > -margin, "no_worse")
                           .when(F.col("upper") < -margin, "worse").otherwise("inconclusive"))
            .withColumn("times_to_decide", F.when(F.col("verdict") == "inconclusive", needed)))


# ── scores ───────────────────────────────────────────────────────────────────

def _direction(up: Column) -> Column:
    return F.when(up == F.col("higher_passes"), "better").otherwise("worse")


def runs_for_means(spread: Column, difference: Column, confidence: float, power: float = POWER) -> Column:
    """Scores per batch to see this difference of means; null when none or no spread."""
    z = N.z_value(1 - (1 - confidence) / 2) + N.z_value(power)
    ratio = z * spread / F.abs(difference)
    return F.when((difference != 0) & (spread > 0), F.greatest(F.lit(2), F.ceil(2 * ratio * ratio)).cast("long"))


def compare_means(matched: DataFrame, confidence: float, bounds: bool = True) -> DataFrame:
    """Welch's test of mean B - mean A. Reads n/mean/sd of both sides and
    `higher_passes`; fewer than two scores on a side gives no verdict."""
    c = F.col
    enough = (c("n_a") >= 2) & (c("n_b") >= 2)
    va, vb = c("sd_a") * c("sd_a") / c("n_a"), c("sd_b") * c("sd_b") / c("n_b")
    out = (spread(matched).withColumn("difference", F.when(enough, c("mean_b") - c("mean_a")))
           .withColumn("_se2", F.when(enough, va + vb))
           .withColumn("standard_error", F.sqrt("_se2"))
           .withColumn("df", F.when(c("_se2") > 0, c("_se2") * c("_se2")
                                    / (va * va / (c("n_a") - 1) + vb * vb / (c("n_b") - 1))))
           .withColumn("t", F.when(c("_se2") > 0, c("difference") / c("standard_error")))
           .withColumn("p_value", F.when(~enough, None).when(c("_se2") == 0, F.when(c("difference") == 0, 1.0).otherwise(0.0))
                       .otherwise(F.least(F.lit(1.0), 2 * N.t_above(F.abs("t"), c("df"))))))
    # the interval excludes zero exactly when the two-sided p is below 1 - confidence
    apart = c("p_value") < 1 - confidence
    out = (out.withColumn("verdict", F.when(~enough, None).when(apart, _direction(c("difference") > 0))
                          .otherwise("no_difference"))
           .withColumn("times_to_decide", F.when(c("verdict") == "no_difference", runs_for_means(
               F.greatest("sd_a", "sd_b"), c("difference"), confidence))))
    if bounds:
        reach = F.when(~enough, None).when(c("_se2") == 0, 0.0).otherwise(
            N.t_quantile(1 - (1 - confidence) / 2, c("df")) * c("standard_error"))
        out = (out.withColumn("_reach", reach).withColumn("lower", c("difference") - c("_reach"))
               .withColumn("upper", c("difference") + c("_reach")).drop("_reach"))
    return out.drop("_se2")


def _digit_sum_above(product: int, skip: int, base_bits: int) -> int:
    # digits base 2^bits hold counts; their sum is the remainder by (base - 1)
    return (product >> (skip * base_bits)) % ((1 << base_bits) - 1)


def _u_tail(u: int, n_a: int, n_b: int) -> float:
    """P(U >= u) without ties: arrangements counted as the digits of one whole
    number, the Gaussian binomial at q = 2^bits."""
    import math
    m, n = sorted((n_a, n_b))
    total = math.comb(m + n, m)
    bits = total.bit_length() + 1
    top = bottom = 1
    for i in range(1, m + 1):
        top *= (1 << bits * (n + i)) - 1
        bottom *= (1 << bits * i) - 1
    return _digit_sum_above(top // bottom, max(u, 0), bits) / total


def _signed_tail(w: int, n: int) -> float:
    """P(W <= w) for signed ranks without ties: sign patterns as digits."""
    bits, product = n + 1, 1
    for rank in range(1, n + 1):
        product *= 1 + (1 << bits * rank)
    low = product & ((1 << bits * (w + 1)) - 1)
    return _digit_sum_above(low, 0, bits) / 2 ** n


@F.pandas_udf(T.DoubleType())
def _u_tail_udf(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for u, n_a, n_b in parts:
        yield pd.Series([_u_tail(int(x), int(y), int(z)) for x, y, z in zip(u, n_a, n_b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _signed_tail_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for w, n in parts:
        yield pd.Series([_signed_tail(int(x), int(y)) for x, y in zip(w, n)], dtype="float64")


def compare_ranks(scores: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """Mann-Whitney of B against A. `scores` has keys, side ('a'/'b'), score
    and higher_passes, scores at reporting precision.

    Equal scores are counted before the shuffle, so ranks come from running
    totals over distinct scores, never from sorting the results themselves.
    """
    counted = scores.groupBy(*keys, "higher_passes", "score").agg(
        F.count_if(F.col("side") == "a").alias("ca"), F.count_if(F.col("side") == "b").alias("cb"))
    below = W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_a_below", F.coalesce(F.sum("ca").over(below), F.lit(0)))
    t = (F.col("ca") + F.col("cb")).cast("double")
    got = placed.groupBy(*keys, "higher_passes").agg(
        F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"),
        F.sum(F.col("cb") * (F.col("_a_below") + F.col("ca") / 2)).alias("u_b"),
        F.sum(t * t * t - t).alias("_ties"))
    c = F.col
    na, nb = c("n_a").cast("double"), c("n_b").cast("double")
    n = na + nb
    variance = na * nb / 12 * ((n + 1) - c("_ties") / (n * (n - 1)))
    exact = (F.least("n_a", "n_b") < 8) & (c("_ties") == 0)
    high = F.greatest(c("u_b"), na * nb - c("u_b"))
    enough = F.least("n_a", "n_b") >= RANK_FLOOR
    out = (spread(got).withColumn("effect", F.when(enough, c("u_b") / (na * nb)))
           .withColumn("method", F.when(~enough, None).when(exact, "exact").otherwise("normal"))
           .withColumn("_v", variance)
           .withColumn("_normal", F.when(c("_v") <= 0, 1.0).otherwise(F.least(
               F.lit(1.0), 2 * N.normal_above((high - na * nb / 2 - 0.5) / F.sqrt("_v"))))))
    few = (out.filter(exact & enough).select(F.round(high).cast("long").alias("_u"), "n_a", "n_b").distinct()
           .withColumn("_exact", F.least(F.lit(1.0), 2 * _u_tail_udf("_u", "n_a", "n_b")))
           .withColumnsRenamed({"n_a": "_na", "n_b": "_nb"}))
    out = out.withColumn("_h", F.round(high).cast("long")).join(
        few, (c("_h") == c("_u")) & (c("n_a") == c("_na")) & (c("n_b") == c("_nb")), "left")
    return (out.withColumn("p_value", F.when(c("method") == "exact", c("_exact")).when(enough, c("_normal")))
            .withColumn("verdict", F.when(~enough, None).when(
                (c("p_value") <= 1 - confidence) & (c("effect") != 0.5), _direction(c("effect") > 0.5))
                .otherwise("no_difference"))
            .drop("_ties", "_v", "_normal", "_u", "_na", "_nb", "_h", "_exact"))


# ── every pair at once ───────────────────────────────────────────────────────

def _exact_only(value):
    """The function below runs for every row, whatever branch its result is
    used in: rows that take the normal tail hand it nothing to count."""
    return F.coalesce(F.when(F.col("wilcoxon_method") == "exact", value), F.lit(0)).cast("long")


def compare_paired(pairs: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """One verdict over all (entry, check) pairs: the paired t-test on rate
    differences, and Wilcoxon's signed ranks beside it. `pairs` has keys,
    rate_a and rate_b. Equal gaps are counted first and running totals are
    sliced, so one comparison's pairs never meet in one task."""
    c = F.col
    gap = pairs.withColumn("_d", c("rate_b") - c("rate_a"))
    basic = gap.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("_d").alias("_mean"),
                                   F.stddev_samp("_d").alias("_sd"), F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    sized = (gap.filter("_d <> 0").groupBy(*keys, F.abs("_d").alias("_size")).agg(
        F.count_if(c("_d") > 0).alias("_up"), F.count_if(c("_d") < 0).alias("_down"))
        .withColumn("_all", c("_up") + c("_down")))
    placed = running_before(sized, keys, ["_size"], F.floor(c("_size") * 4096).cast("long"), ["_all"])
    rank = c("before__all") + (c("_all") + 1) / 2
    t = c("_all").cast("double")
    signed = placed.groupBy(*keys).agg(
        F.sum("_all").alias("n_ranked"), F.sum(rank * c("_up")).alias("_plus"), F.sum(rank * c("_down")).alias("_minus"),
        F.sum(t * t * t - t).alias("_ties"))
    enough = c("n_pairs") >= PAIR_FLOOR
    flat = c("_low") == c("_high")
    n = F.coalesce(c("n_ranked"), F.lit(0)).cast("double")
    out = (basic.join(signed, keys, "left")
           .withColumn("difference", F.when(enough, F.when(flat, c("_low")).otherwise(c("_mean"))))
           .withColumn("t", F.when(enough & ~flat, c("_mean") / (c("_sd") / F.sqrt("n_pairs"))))
           .withColumn("p_value", F.when(~enough, None).when(flat, F.when(c("_low") == 0, 1.0).otherwise(0.0))
                       .otherwise(F.least(F.lit(1.0), 2 * N.t_above(F.abs("t"), c("n_pairs") - 1))))
           .withColumn("verdict", F.when(~enough, None).when(c("p_value") < 1 - confidence, F.when(
               c("difference") > 0, "better").otherwise("worse")).otherwise("no_difference"))
           .withColumn("statistic", F.when(enough, F.coalesce(F.least("_plus", "_minus"), F.lit(0.0))))
           .withColumn("wilcoxon_method", F.when(~enough, None).when(
               (n <= 50) & (F.coalesce(c("_ties"), F.lit(0.0)) == 0), "exact").otherwise("normal"))
           .withColumn("_v", n * (n + 1) * (2 * n + 1) / 24 - c("_ties") / 48)
           .withColumn("p_wilcoxon", F.when(~enough, None).when(n == 0, 1.0)
                       .when(c("wilcoxon_method") == "exact", F.least(F.lit(1.0), 2 * _signed_tail_udf(
                           _exact_only(c("statistic")), _exact_only(c("n_ranked")))))
                       .when(c("_v") <= 0, 1.0)
                       .otherwise(F.least(F.lit(1.0), 2 * N.normal_above(F.abs((c("statistic") - n * (n + 1) / 4) / F.sqrt("_v"))))))
           .withColumn("agrees", (c("p_wilcoxon") <= 1 - confidence) == (c("verdict") != "no_difference")))
    return out.drop("_mean", "_sd", "_low", "_high", "_plus", "_minus", "_ties", "_v")


# ── the comparison as a whole ────────────────────────────────────────────────

def comparison_outcome(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict counts and the one overall answer per comparison."""
    from ..schemas import COMPARISON_VERDICTS
    tally = compared.groupBy(*keys).agg(*[
        F.count_if(F.coalesce("verdict", F.lit("none")) == v).alias(f"n_{v}") for v in COMPARISON_VERDICTS],
        F.count(F.lit(1)).alias("_total"))
    c = F.col
    return tally.withColumn("outcome", F.when(c("n_worse") > 0, "worse").when(c("n_better") > 0, "better")
                            .when((c("_total") > 0) & (c("n_no_worse") == c("_total")), "no_worse")
                            .when((c("n_no_worse") > 0) | (c("n_inconclusive") > 0), "inconclusive")
                            .when(c("n_no_difference") > 0, "no_difference").otherwise("none")).drop("_total")


def comparable(pairs: DataFrame, batches: DataFrame, contents: DataFrame) -> DataFrame:
    """Why two batches may not be compared (null when they may): not finished,
    another scope, or content that differs. `contents` has batch_id, entry_id
    and a `content` digest without the recorded answer; batches run the same
    content when their sorted digests hash alike, compared set-wise."""
    digests = contents.groupBy("batch_id").agg(
        F.sum(F.xxhash64("entry_id", "content").cast("decimal(38,0)")).alias("_digest"),
        F.count(F.lit(1)).alias("_entries"))
    facts = batches.join(digests, "batch_id", "left")
    a = facts.select(*[F.col(x).alias(f"{x}_a") for x in facts.columns])
    b = facts.select(*[F.col(x).alias(f"{x}_b") for x in facts.columns])
    c = F.col
    out = pairs.join(a, c("batch_a") == c("batch_id_a")).join(b, c("batch_b") == c("batch_id_b"))
    return out.select("batch_a", "batch_b", F.when(~c("finished_a") | ~c("finished_b"), "not_finished")
                      .when(~c("scope_id_a").eqNullSafe(c("scope_id_b")), "another_scope")
                      .when(~c("_digest_a").eqNullSafe(c("_digest_b")) | ~c("_entries_a").eqNullSafe(c("_entries_b")),
                            "content_differs").alias("refused"))
