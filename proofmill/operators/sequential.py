"""Batches that run until there is an answer: looks, decisions, next waves."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..schemas import IN_FLIGHT_STATUSES, JUDGE_ENGINE
from .batch import KEYS, threshold_value
from .keyed import spread

LOOKS = 8  # fixed value: the most looks a batch takes


def looks(first: Column, maximum: Column) -> Column:
    """The first look, then evenly spaced ones up to the maximum."""
    first, maximum = first.cast("int"), maximum.cast("int")
    count = F.least(F.lit(LOOKS), maximum - first + 1)
    step = (maximum - first) / (count - 1)
    spaced = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(1))), lambda i: first + F.bround(step * i).cast("int"))
    return F.when(maximum <= first, F.array(first)).otherwise(F.array_sort(F.array_distinct(F.concat(spaced, F.array(maximum)))))


def even_level(looks_column: Column, confidence: float) -> Column:
    """Each look's confidence when the error is split evenly over the looks."""
    return 1 - (1 - confidence) / F.size(looks_column)


def outcomes(results: DataFrame) -> DataFrame:
    """Decided results as (entry, label, time, passed)."""
    return results.filter(~F.col("errored") & F.col("passed").isNotNull()).select(*KEYS, "batch_index", "passed")


def scores(results: DataFrame) -> DataFrame:
    """Scores as (entry, label, time, score), errored ones left out."""
    return results.filter(~F.col("errored") & F.col("score").isNotNull()).select(*KEYS, "batch_index", "score")


def _at_looks(rows: DataFrame, plans: DataFrame, sums: dict[str, Column], widen: dict[str, Column] | None = None) -> DataFrame:
    """Running totals of each check at each look with new results.

    A result belongs to the first look at or after its time, so results are
    summed per (check, look) before the shuffle; the totals up to each look
    then run over at most eight rows per check.
    """
    widen = widen or {}
    slotted = rows.join(plans, "batch_id").withColumn(
        "look", F.array_min(F.filter("looks", lambda x: x >= F.col("batch_index")))).filter("look is not null")
    carried = [c for c in plans.columns if c not in ("batch_id", "looks")]
    per = slotted.groupBy(*KEYS, "look").agg(*[c.alias(n) for n, c in {**sums, **widen}.items()],
                                             *[F.first(c).alias(c) for c in carried])
    so_far = W.partitionBy(*KEYS).orderBy("look").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = per
    for n in sums:
        out = out.withColumn(n, F.sum(n).over(so_far))
    for n in widen:
        out = out.withColumn(n, (F.min if n.startswith("low") else F.max)(n).over(so_far))
    return out


def _first_answer(judged: DataFrame, keep: list[str]) -> DataFrame:
    """The first look that decides is final; else how things stand at the last."""
    facts = F.struct("verdict", "look", *keep)
    got = judged.groupBy(*KEYS).agg(F.min_by(F.when(F.col("verdict").isNotNull(), facts), F.when(F.col("verdict").isNotNull(), F.col("look"))).alias("_d"),
                                    F.max_by(facts, F.col("look")).alias("_l"))
    pick = F.coalesce("_d", "_l")
    return got.select(*KEYS, F.col("_d.verdict").alias("verdict"), F.col("_d.look").alias("at_time"),
                      *[pick[k].alias(k) for k in keep])


def decide(results: DataFrame, plans: DataFrame, agreement: bool = False) -> DataFrame:
    """Each check's sequential verdict. `plans`: batch_id, looks, level, target.
    With `agreement`, the runs that gave the usual verdict count."""
    seen = _at_looks(results, plans, {"evaluated": F.count(F.lit(1)), "passes": F.count_if("passed")})
    counted = F.greatest("passes", F.col("evaluated") - F.col("passes")) if agreement else F.col("passes")
    alpha = 1 - F.col("level")
    judged = (spread(seen).withColumn("passes", counted)
              .withColumn("_p", N.at_least(F.col("passes"), F.col("evaluated"), F.col("target")))
              .withColumn("_f", N.at_most(F.col("passes"), F.col("evaluated"), F.col("target")))
              .withColumn("verdict", F.when(F.col("_p") <= alpha, "pass").when(F.col("_f") <= alpha, "fail")))
    return _first_answer(judged, ["passes", "evaluated"])


def decide_mean(scored: DataFrame, plans: DataFrame) -> DataFrame:
    """The same for averages. `plans`: batch_id, looks, level, threshold,
    higher_passes; a look needs two scores."""
    s = F.col("score")
    seen = _at_looks(scored, plans, {"n": F.count(F.lit(1)), "total": F.sum(s), "squares": F.sum(s * s)},
                     {"low_score": F.min(s), "high_score": F.max(s)}).filter("n >= 2")
    flat = F.col("low_score") == F.col("high_score")
    mean = F.when(flat, F.col("low_score")).otherwise(F.col("total") / F.col("n"))
    alpha = 1 - F.col("level")
    judged = (spread(seen).withColumn("mean", mean)
              .withColumn("sd", F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(
                  F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)) / (F.col("n") - 1))))
              .withColumn("t", F.when(~flat, (F.col("mean") - F.col("threshold")) / (F.col("sd") / F.sqrt("n"))))
              .withColumn("_t", F.when(F.col("higher_passes"), F.col("t")).otherwise(-F.col("t")))
              .withColumn("_ahead", F.when(F.col("higher_passes"), F.col("mean") >= F.col("threshold")).otherwise(F.col("mean") <= F.col("threshold")))
              .withColumn("verdict", F.when(flat, F.when(F.col("_ahead"), "pass").otherwise("fail"))
                          .when(N.t_above(F.col("_t"), F.col("n") - 1) <= alpha, "pass")
                          .when(N.t_above(-F.col("_t"), F.col("n") - 1) <= alpha, "fail")))
    return _first_answer(judged, ["n", "mean", "sd"])


def judged_checks(checks: DataFrame, engine: str) -> DataFrame:
    """The checks a batch gives an answer: not left out; judge checks on a
    recorded answer for stability; scored ones with a threshold for averages.
    Reads left_out, check_engine, comparison, recorded_answer, raw_threshold."""
    kept = checks.filter(~F.col("left_out"))
    if engine == "sequential_judge_stability":
        return kept.filter((F.col("check_engine") == JUDGE_ENGINE) & F.col("recorded_answer"))
    if engine == "sequential_t":
        return (kept.withColumn("threshold", threshold_value(F.col("raw_threshold"))).filter("comparison is not null and threshold is not null")
                .withColumn("higher_passes", F.col("comparison") == "gte"))
    return kept


def advance(batches: DataFrame, asked: DataFrame, decided: DataFrame) -> DataFrame:
    """What each open batch does next: done when every judged check is decided
    or the last look is reached, else the bounds of its next wave. `batches`:
    batch_id, looks, waves_released; `asked`: judged checks; `decided`: their
    verdicts."""
    answered = decided.filter("verdict is not null").groupBy("batch_id").agg(F.count(F.lit(1)).alias("_yes"))
    wanted = asked.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_all"))
    out = batches.join(wanted, "batch_id", "left").join(answered, "batch_id", "left").withColumn(
        "undecided", F.coalesce("_all", F.lit(0)) - F.coalesce("_yes", F.lit(0)))
    done = (F.col("undecided") == 0) | (F.col("waves_released") >= F.size("looks"))
    return out.select("batch_id", "undecided", done.alias("done"),
                      F.when(~done, F.element_at("looks", F.greatest(F.col("waves_released"), F.lit(1))) + 1).alias("first"),
                      F.when(~done, F.get("looks", F.col("waves_released"))).alias("last"))


def stalled_batches(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """Open wave batches with no run in flight."""
    flying = runs.filter(F.col("status").isin(*IN_FLIGHT_STATUSES)).select("batch_id")
    return batches.filter(F.col("waves_released").isNotNull() & F.col("status").isin("Pending", "Running")).join(flying, "batch_id", "left_anti")
