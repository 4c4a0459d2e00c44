"""Probability tails and quantiles as Spark columns.

Spark SQL has no gamma, beta or error function. Each tail here is a ratio of
two integrals of one smooth bump, so no normalising constant is needed:

* beta (and through it binomial and Student t): with x = sin(angle)^2 the
  density is sin^(2a-1) * cos^(2b-1), which is never wider than a normal curve
  of known spread, so a fixed window around the peak holds all of it;
* chi-square (and through it normal): u^(df-1) * exp(-u*u), the same idea.

The cost is a fixed number of nodes per row whatever the counts are, so a
group of 10 runs and one of 10 billion cost the same.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 64
_HALF_PI = math.pi / 2


def z_value(probability: float) -> float:
    """Standard normal quantile of a plan-time constant."""
    return NormalDist().inv_cdf(probability)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _node_table() -> Column:
    # Gauss-Legendre nodes pushed through s*s*(3-2s), which crowds them towards
    # both ends and so smooths fractional powers there
    x, w = np.polynomial.legendre.leggauss(NODES)
    s, w = (1 + x) / 2, w / 2
    return F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w"))
                     for a, b in zip(s * s * (3 - 2 * s), w * 6 * s * (1 - s), strict=True)])


def _area(log_density: Callable[[Column], Column], low: Column, high: Column) -> Column:
    width = high - low
    return F.aggregate(
        _node_table(), F.lit(0.0),
        lambda total, node: total + node["w"] * F.exp(log_density(low + width * node["x"])),
    ) * width


# ── beta ─────────────────────────────────────────────────────────────────────

def _beta_frame(a: Column, b: Column) -> Column:
    """Exponents, peak and window of the beta density over the angle."""
    p, q = 2 * a - 1, 2 * b - 1
    peak = F.atan2(F.sqrt(F.greatest(p, F.lit(0.0))), F.sqrt(F.greatest(q, F.lit(0.0))))
    reach = 6.0 / F.sqrt(F.greatest(a + b - 1, F.lit(0.02)))
    return let(
        F.struct(p.alias("p"), q.alias("q"), peak.alias("peak"), reach.alias("reach")),
        lambda f: F.struct(
            f["p"].alias("p"), f["q"].alias("q"),
            F.greatest(f["peak"] - f["reach"], F.lit(0.0)).alias("low"),
            F.least(f["peak"] + f["reach"], F.lit(_HALF_PI)).alias("high"),
            _log_power(f["p"], f["q"], f["peak"]).alias("top")))


def _log_power(p: Column, q: Column, angle: Column) -> Column:
    # zero exponents must not meet ln(0)
    return (F.when(p == 0, 0.0).otherwise(p * F.ln(F.sin(angle)))
            + F.when(q == 0, 0.0).otherwise(q * F.ln(F.cos(angle))))


def _beta_area(f: Column, low: Column, high: Column) -> Column:
    return _area(lambda angle: _log_power(f["p"], f["q"], angle) - f["top"], low, high)


def _beta_sides(a: Column, b: Column, x: Column) -> Column:
    """Areas below and above x, unnormalised."""
    angle = F.asin(F.sqrt(x))
    return let(
        F.struct(_beta_frame(a, b).alias("f"), angle.alias("angle")),
        lambda s: let(
            F.struct(s["f"].alias("f"),
                     F.least(F.greatest(s["angle"], s["f"]["low"]), s["f"]["high"]).alias("cut")),
            lambda c: F.struct(_beta_area(c["f"], c["f"]["low"], c["cut"]).alias("below"),
                               _beta_area(c["f"], c["cut"], c["f"]["high"]).alias("above"))))


def beta_below(a, b, x) -> Column:
    """P(B <= x) for B ~ Beta(a, b), a and b at least one half."""
    return let(_beta_sides(col(a), col(b), col(x)),
               lambda s: s["below"] / (s["below"] + s["above"]))


def beta_above(a, b, x) -> Column:
    return let(_beta_sides(col(a), col(b), col(x)),
               lambda s: s["above"] / (s["below"] + s["above"]))


def _beta_angle(a: Column, b: Column, probability: Column) -> Column:
    """The angle with the given area below it: halving, then Newton steps."""
    def start(f):
        return F.struct(f.alias("f"), _beta_area(f, f["low"], f["high"]).alias("total"))

    def share(s, angle):
        return _beta_area(s["f"], s["f"]["low"], angle) / s["total"]

    def halve(s):
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(10)),
            F.struct(s["f"]["low"].alias("low"), s["f"]["high"].alias("high")),
            lambda box, _: let((box["low"] + box["high"]) / 2, lambda middle: F.when(
                share(s, middle) < s["q"],
                F.struct(middle.alias("low"), box["high"].alias("high"))).otherwise(
                F.struct(box["low"].alias("low"), middle.alias("high")))))

    def polish(s, box):
        def step(angle, _):
            slope = F.exp(_log_power(s["f"]["p"], s["f"]["q"], angle) - s["f"]["top"]) / s["total"]
            return F.least(F.greatest(angle - (share(s, angle) - s["q"]) / slope, box["low"]),
                           box["high"])
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), (box["low"] + box["high"]) / 2, step)

    return let(let(_beta_frame(a, b), start), lambda s: let(
        F.struct(s["f"].alias("f"), s["total"].alias("total"), probability.alias("q")),
        lambda k: let(halve(k), lambda box: polish(k, box))))


def beta_quantile(a, b, probability) -> Column:
    return let(F.sin(_beta_angle(col(a), col(b), col(probability))), lambda s: s * s)


# ── binomial ─────────────────────────────────────────────────────────────────

def at_least(k, n, p) -> Column:
    """P(X >= k) for X ~ Binomial(n, p)."""
    k, n, p = (col(v).cast("double") for v in (k, n, p))
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(beta_below(k, n - k + 1, p))


def at_most(k, n, p) -> Column:
    """P(X <= k) for X ~ Binomial(n, p)."""
    k, n, p = (col(v).cast("double") for v in (k, n, p))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(beta_above(k + 1, n - k, p))


def rate_lower(passes, n, confidence) -> Column:
    """Exact one-sided lower bound of a pass rate."""
    k, n, c = (col(v).cast("double") for v in (passes, n, confidence))
    alpha = 1 - c
    return (F.when(n <= 0, None).when(k == 0, 0.0).when(k == n, F.pow(alpha, 1 / n))
            .otherwise(beta_quantile(k, n - k + 1, alpha)))


def rate_upper(passes, n, confidence) -> Column:
    """Exact one-sided upper bound of a pass rate."""
    k, n, c = (col(v).cast("double") for v in (passes, n, confidence))
    alpha = 1 - c
    return (F.when(n <= 0, None).when(k == n, 1.0).when(k == 0, 1 - F.pow(alpha, 1 / n))
            .otherwise(beta_quantile(k + 1, n - k, 1 - alpha)))


def wilson(passes: Column, n: Column, confidence: float) -> Column:
    """Two-sided score interval of a pass rate: struct(low, high)."""
    z = z_value(1 - (1 - confidence) / 2)
    k, n = passes.cast("double"), n.cast("double")
    rate = k / n
    scale = 1 + z * z / n
    centre = (rate + z * z / (2 * n)) / scale
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / scale
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"),
                                  F.least(F.lit(1.0), centre + half).alias("high")))


# ── Student t ────────────────────────────────────────────────────────────────

def t_above(t, df) -> Column:
    """P(T >= t); degrees of freedom may be fractional, 1 or more."""
    t, df = col(t), col(df).cast("double")
    tail = beta_below(df / 2, F.lit(0.5), df / (df + t * t)) / 2
    return F.when(t > 0, tail).otherwise(1 - tail)


def t_below(t, df) -> Column:
    t = col(t)
    return t_above(-t, df)


def t_quantile(probability: float, df) -> Column:
    """The t with P(T <= t) = probability, a plan-time constant above 0.5."""
    df = col(df).cast("double")
    angle = _beta_angle(df / 2, F.lit(0.5), F.lit(2 * (1 - float(probability))))
    return F.sqrt(df) / F.tan(angle)


# ── chi-square and normal ────────────────────────────────────────────────────

def chi_square_above(x, df) -> Column:
    """P(X >= x) for chi-square with a whole number of degrees of freedom."""
    x, df = col(x), col(df).cast("double")
    power = df - 1
    frame = let(F.struct(power.alias("p"), F.sqrt(power / 2).alias("peak"),
                         F.sqrt(x / 2).alias("cut")),
                lambda f: F.struct(
                    f["p"].alias("p"), F.greatest(f["peak"] - 6, F.lit(0.0)).alias("low"),
                    (f["peak"] + 6).alias("high"), f["cut"].alias("raw"),
                    F.least(F.greatest(f["cut"], F.greatest(f["peak"] - 6, F.lit(0.0))),
                            f["peak"] + 6).alias("cut"),
                    (F.when(f["p"] == 0, 0.0).otherwise(f["p"] * F.ln(f["peak"]))
                     - f["peak"] * f["peak"]).alias("top")))

    def density(f):
        return lambda u: (F.when(f["p"] == 0, 0.0).otherwise(f["p"] * F.ln(u)) - u * u - f["top"])

    return F.when(x <= 0, 1.0).otherwise(let(frame, lambda f: let(
        F.struct(_area(density(f), f["low"], f["cut"]).alias("below"),
                 _area(density(f), f["cut"], f["high"]).alias("above")),
        lambda s: s["above"] / (s["below"] + s["above"]))))


def normal_above(z) -> Column:
    """P(Z >= z)."""
    z = col(z)
    tail = chi_square_above(z * z, F.lit(1.0)) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, moved up by 8 so it holds from 0 on."""
    n = n.cast("double")
    product = (n + 1) * (n + 2) * (n + 3) * (n + 4) * (n + 5) * (n + 6) * (n + 7) * (n + 8)
    return let(n + 8, lambda m: (m + 0.5) * F.ln(m) - m + 0.9189385332046727 + 1 / (12 * m) - 1 / (360 * F.pow(m, F.lit(3.0)))
               + 1 / (1260 * F.pow(m, F.lit(5.0))) - 1 / (1680 * F.pow(m, F.lit(7.0)))) - F.ln(product)


def r4(value: Column) -> Column:
    """Four decimals, the precision every statistic is reported at."""
    return F.round(value, 4)
