"""What a batch of runs came to: folds, gates, averages, roll-ups.

A batch runs the same entries many times. Everything below works on all
batches at once, from (batch_id, entry_id, label) groups. Raw results are only
ever reduced by partial aggregation; numbers are worked out on the groups.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.numeric import let, r4
from ..functions.text import number_of
from ..schemas import IN_FLIGHT_STATUSES, JUDGE_ENGINE, MAX_TIMES, POWER
from .keyed import join_on, spread

KEYS = ["batch_id", "entry_id", "label"]
SCORE_ENGINES = ("one_sample_t", "sequential_t")
STABILITY_ENGINES = ("judge_stability", "sequential_judge_stability")
GATE_ENGINES = ("binomial_gate", "sequential_gate")


def _ran(column: str = "status") -> Column:
    return F.col(column) != "NotRan"


# ── folding results ──────────────────────────────────────────────────────────

def fold_results(results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per check: decided, passed, failed and errored results."""
    decided = ~F.col("errored")
    return results.groupBy(*keys).agg(
        F.count_if(decided).alias("evaluated"),
        F.count_if(decided & F.col("passed")).alias("passed"),
        F.count_if(decided & ~F.col("passed")).alias("failed"),
        F.count_if(F.col("errored")).alias("errored"))


def fold(runs: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per check: evaluated, passed, failed, errored, not_ran.

    `runs` carries the labels each run asks in `asked`; a check missing from a
    run's results counts as errored. No run is joined to its results: both
    sides are counted first, since errored = asked - evaluated.
    """
    group = [k for k in keys if k != "label"]
    asked = (runs.groupBy(*group, "asked")
             .agg(F.count_if(_ran()).alias("ran"), F.count_if(~_ran()).alias("not_ran"))
             .withColumn("label", F.explode("asked"))
             .groupBy(*keys).agg(F.sum("ran").alias("ran"), F.sum("not_ran").alias("not_ran")))
    got = fold_results(results, keys).select(*keys, "evaluated", "passed")
    zero = F.lit(0)
    return (join_on(asked, got, keys, "left")
            .select(*keys,
                    F.coalesce("evaluated", zero).alias("evaluated"),
                    F.coalesce("passed", zero).alias("passed"),
                    (F.coalesce("evaluated", zero) - F.coalesce("passed", zero)).alias("failed"),
                    (F.col("ran") - F.coalesce("evaluated", zero)).alias("errored"),
                    F.col("not_ran")))


def series(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Every point of every check for charts: outcome per time, or why there
    is none. One row per (run, asked label); run ids spread the join evenly."""
    asked = runs.select("batch_id", "entry_id", "batch_index", "run_id", "status", "error",
                        F.explode("asked").alias("label"))
    got = results.select("run_id", "label", "passed", "score", "detail", "errored")
    point = asked.join(got, ["run_id", "label"], "left")
    counted = (F.col("status") != "NotRan") & F.col("errored").isNotNull() & ~F.col("errored")
    return point.select(
        *KEYS, "batch_index", "run_id", "status",
        F.when(counted, F.col("passed")).alias("passed"),
        F.when(counted, r4(F.col("score"))).alias("score"),
        F.when(~_ran(), F.col("error"))
        .when(F.col("errored").isNull(), F.lit("no_result"))
        .when(F.col("errored"), F.col("detail")).alias("problem"))


# ── the gate ─────────────────────────────────────────────────────────────────

def gate_columns(passes: Column, n: Column, target: Column, confidence: float) -> dict[str, Column]:
    """Exact one-sided tests both ways against a target rate."""
    alpha = 1 - confidence
    p_pass = F.when(n > 0, N.at_least(passes, n, target))
    p_fail = F.when(n > 0, N.at_most(passes, n, target))
    return {"p_pass": p_pass, "p_fail": p_fail,
            "verdict": F.when(F.col("p_pass").isNull(), None)
            .when(F.col("p_pass") <= alpha, "pass")
            .when(F.col("p_fail") <= alpha, "fail").otherwise("inconclusive")}


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    # one projection per column, as later ones read earlier ones
    for name, column in columns.items():
        df = df.withColumn(name, column)
    return df


def gate(folded: DataFrame, target: float | Column, confidence: float) -> DataFrame:
    """Does each check pass at least `target` of the time?"""
    target = target if isinstance(target, Column) else F.lit(float(target))
    return _add(spread(folded), gate_columns(F.col("passed"), F.col("evaluated"), target, confidence))


def agreement_gate(folded: DataFrame, target: float | Column, confidence: float) -> DataFrame:
    """Does a judge give its usual verdict at least `target` of the time?"""
    target = target if isinstance(target, Column) else F.lit(float(target))
    out = (spread(folded).withColumn("agreeing", F.greatest("passed", "failed"))
           .withColumn("usual", F.when(F.col("evaluated") == 0, None)
                       .when(F.col("passed") >= F.col("failed"), "pass").otherwise("fail")))
    return _add(out, gate_columns(F.col("agreeing"), F.col("evaluated"), target, confidence))


def exact_bounds(folded: DataFrame, confidence: float, passes: str = "passed") -> DataFrame:
    """One-sided exact bounds of every pass rate, worked out once per distinct
    (passes, n) and joined back."""
    shapes = folded.select(F.col(passes).alias("_k"), F.col("evaluated").alias("_n")).distinct()
    shapes = spread(shapes)
    bounds = shapes.filter("_n > 0").select(
        "_k", "_n", N.rate_lower(F.col("_k"), F.col("_n"), confidence).alias("lower"),
        N.rate_upper(F.col("_k"), F.col("_n"), confidence).alias("upper"))
    return (folded.join(bounds, (folded[passes] == bounds["_k"])
                        & (folded["evaluated"] == bounds["_n"]), "left").drop("_k", "_n"))


def wilson_rates(folded: DataFrame, confidence: float) -> DataFrame:
    interval = N.wilson(F.col("passed"), F.col("evaluated"), confidence)
    return (folded.withColumn("_w", interval)
            .withColumn("rate", F.col("passed") / F.nullif(F.col("evaluated"), F.lit(0)))
            .withColumn("rate_low", F.col("_w.low")).withColumn("rate_high", F.col("_w.high"))
            .drop("_w"))


def gate_rule(n: Column, target: Column, confidence: float) -> Column:
    """struct(pass_at_least, fail_at_most) at n runs; either is null when no
    count can decide that way. Halving over whole counts, so n may be large."""
    alpha = 1 - confidence
    n, p = n.cast("double"), target
    span = F.sqrt(n * p * (1 - p)) * 12 + 2

    def lowest(s):  # fewest passes k with P(X >= k) <= alpha, between low (no) and high (yes)
        start = F.struct(F.greatest(F.floor(s["n"] * s["p"] - 1), F.lit(0)).cast("double").alias("no"),
                         F.least(F.ceil(s["n"] * s["p"] + s["span"]), s["n"]).cast("double").alias("yes"))
        box = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, lambda b, _: F.when(
            b["yes"] - b["no"] <= 1, b).otherwise(let(
                F.floor((b["no"] + b["yes"]) / 2).cast("double"),
                lambda m: F.when(N.at_least(m, s["n"], s["p"]) <= alpha,
                                 F.struct(b["no"].alias("no"), m.alias("yes")))
                .otherwise(F.struct(m.alias("no"), b["yes"].alias("yes"))))))
        return F.when(F.pow(s["p"], s["n"]) <= alpha, box["yes"].cast("long"))

    def highest(s):  # most passes k with P(X <= k) <= alpha
        start = F.struct(F.greatest(F.floor(s["n"] * s["p"] - s["span"]), F.lit(0)).cast("double").alias("yes"),
                         F.least(F.ceil(s["n"] * s["p"] + 1), s["n"]).cast("double").alias("no"))
        box = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, lambda b, _: F.when(
            b["no"] - b["yes"] <= 1, b).otherwise(let(
                F.floor((b["no"] + b["yes"]) / 2).cast("double"),
                lambda m: F.when(N.at_most(m, s["n"], s["p"]) <= alpha,
                                 F.struct(m.alias("yes"), b["no"].alias("no")))
                .otherwise(F.struct(b["yes"].alias("yes"), m.alias("no"))))))
        return F.when(F.pow(1 - s["p"], s["n"]) <= alpha, box["yes"].cast("long"))

    return F.when(n > 0, let(F.struct(n.alias("n"), p.alias("p"), span.alias("span")),
                             lambda s: F.struct(lowest(s).alias("pass_at_least"),
                                                highest(s).alias("fail_at_most"))))


def gate_rules(targets: DataFrame, confidence: float, limit: int = MAX_TIMES) -> DataFrame:
    """The rule at every size 1..limit for each distinct `target`: one row per
    (target, n). The number of rows depends on the targets, not on the data."""
    sizes = targets.select("target").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(limit))))
    return (spread(sizes)
            .withColumn("_rule", gate_rule(F.col("n"), F.col("target"), confidence))
            .select("target", "n", "_rule.pass_at_least", "_rule.fail_at_most"))


def gate_floor(target: Column, confidence: float) -> Column:
    """Fewest runs at which a perfect record proves the target."""
    alpha = 1 - confidence
    guess = F.greatest(F.ceil(F.log(F.lit(alpha)) / F.log(target) - 1e-9), F.lit(1)).cast("double")
    up = F.when(F.pow(target, guess) > alpha, guess + 1).otherwise(guess)
    return F.when((up > 1) & (F.pow(target, up - 1) <= alpha), up - 1).otherwise(up).cast("long")


def runs_allowing(rules: DataFrame) -> DataFrame:
    """Fewest runs at which the gate passes even with that many misses."""
    return (rules.filter("pass_at_least is not null")
            .groupBy("target", (F.col("n") - F.col("pass_at_least")).cast("long").alias("misses"))
            .agg(F.min("n").cast("long").alias("n")))


def runs_to_decide(gated: DataFrame, rules: DataFrame, passes: str = "passed") -> DataFrame:
    """For inconclusive checks: the smallest new batch that would decide it at
    the observed rate. Checks meet the rule list of their own target; equal
    counts are worked out once."""
    listed = rules.groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct("n", "pass_at_least", "fail_at_most"))).alias("_rules"))
    shapes = (gated.filter("verdict = 'inconclusive'")
              .select("target", F.col(passes).alias("_k"), F.col("evaluated").alias("_n")).distinct()
              .join(listed, "target"))
    rate = F.col("_k") / F.col("_n")

    def decides(rule):
        expected = F.bround(rate * rule["n"])
        return F.when(rate > F.col("target"), expected >= rule["pass_at_least"]) \
            .when(rate < F.col("target"), expected <= rule["fail_at_most"]).otherwise(False)

    found = shapes.select(
        F.col("target").alias("_target"), "_k", "_n",
        F.get(F.filter("_rules", decides), F.lit(0))["n"].alias("times_to_decide"))
    return gated.join(found, (gated["target"] == found["_target"]) & (gated[passes] == found["_k"])
                      & (gated["evaluated"] == found["_n"]), "left").drop("_target", "_k", "_n")


# ── scores ───────────────────────────────────────────────────────────────────

def scored(results: DataFrame) -> DataFrame:
    """Decided results that have a score, at reporting precision."""
    return (results.filter(~F.col("errored") & F.col("score").isNotNull())
            .withColumn("score", r4(F.col("score"))))


def score_summary(results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """n, mean, spread, range and percentiles of each check's scores.

    Equal scores are counted before the shuffle; scores carry four decimals,
    so a group has a bounded number of distinct values however large it is.
    """
    counted = scored(results).groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_c"))
    shares = F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])
    got = counted.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        (F.sum(F.col("_c") * F.col("score")) / F.sum("_c")).alias("mean"),
        F.sum(F.col("_c") * F.col("score") * F.col("score")).alias("_squares"),
        F.min("score").alias("min"), F.max("score").alias("max"),
        F.percentile("score", shares, F.col("_c")).alias("_p"))
    return got.select(
        *keys, "n", "mean",
        F.when(F.col("n") < 2, None).when(F.col("min") == F.col("max"), 0.0).otherwise(
            F.sqrt(F.greatest(F.col("_squares") - F.col("n") * F.col("mean") * F.col("mean"),
                              F.lit(0.0)) / (F.col("n") - 1))).alias("sd"),
        "min", "max", *[F.col("_p")[i].alias(name)
                        for i, name in enumerate(("p10", "p25", "median", "p75", "p90"))])


def score_moments(results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """n, mean and sample spread; the spread is exactly 0 when no score differs."""
    return (scored(results).groupBy(*keys).agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("sd"), F.min("score").alias("low_score"),
        F.max("score").alias("high_score"))
        .withColumn("sd", F.when(F.col("n") < 2, None)
                    .when(F.col("low_score") == F.col("high_score"), 0.0).otherwise(F.col("sd")))
        .withColumn("mean", F.when(F.col("low_score") == F.col("high_score"), F.col("low_score"))
                    .otherwise(F.col("mean")))
        .drop("low_score", "high_score"))


def one_sample_t(moments: DataFrame, confidence: float, bounds: bool = True) -> DataFrame:
    """Is each mean on the passing side of its `threshold`? `higher_passes` is
    the direction. One score proves nothing; no spread is compared exactly."""
    alpha = 1 - confidence
    flat, single = F.col("sd") == 0, F.col("n") < 2
    ahead = F.when(F.col("higher_passes"), F.col("mean") >= F.col("threshold")) \
        .otherwise(F.col("mean") <= F.col("threshold"))
    signed = F.when(F.col("higher_passes"), F.col("t")).otherwise(-F.col("t"))
    out = (spread(moments)
           .withColumn("standard_error", F.when(~single, F.col("sd") / F.sqrt("n")))
           .withColumn("df", F.when(~single, F.col("n") - 1))
           .withColumn("t", F.when(~single & ~flat,
                                   (F.col("mean") - F.col("threshold")) / F.col("standard_error")))
           .withColumn("p_pass", F.when(single, None).when(flat, F.when(ahead, 0.0).otherwise(1.0))
                       .otherwise(N.t_above(signed, F.col("df"))))
           .withColumn("p_fail", F.when(single, None).when(flat, F.when(ahead, 1.0).otherwise(0.0))
                       .otherwise(N.t_above(-signed, F.col("df"))))
           .withColumn("verdict", F.when(single, "inconclusive").when(F.col("p_pass") <= alpha, "pass")
                       .when(F.col("p_fail") <= alpha, "fail").otherwise("inconclusive")))
    if bounds:
        reach = N.t_quantile(confidence, F.col("df")) * F.col("standard_error")
        out = (out.withColumn("_reach", F.when(single, None).when(flat, 0.0).otherwise(reach))
               .withColumn("lower", F.col("mean") - F.col("_reach"))
               .withColumn("upper", F.col("mean") + F.col("_reach")).drop("_reach"))
    return out


def runs_for_mean(spread: Column, difference: Column, confidence: float,
                  power: float = POWER) -> Column:
    """Runs a one-sided t-test needs to see a difference; the normal guess is
    refined with t quantiles until it repeats."""
    first = (N.z_value(confidence) + N.z_value(power)) ** 2

    def settle(ratio):
        guess = F.greatest(F.ceil(F.lit(first) * ratio * ratio), F.lit(2)).cast("double")
        def step(state, _):
            needed = let(N.t_quantile(confidence, state["n"] - 1) + N.t_quantile(power, state["n"] - 1),
                         lambda q: F.greatest(F.ceil(q * q * ratio * ratio), F.lit(2)).cast("double"))
            return F.when(state["done"], state).otherwise(let(needed, lambda m: F.struct(
                m.alias("n"), (m == state["n"]).alias("done"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)),
                           F.struct(guess.alias("n"), F.lit(False).alias("done")), step)["n"]

    return F.when((spread > 0) & (difference > 0), let(spread / difference, settle).cast("long"))


def t_runs_to_decide(tested: DataFrame, confidence: float, limit: int = MAX_TIMES) -> DataFrame:
    needed = runs_for_mean(F.col("sd"), F.abs(F.col("mean") - F.col("threshold")), confidence)
    return tested.withColumn("_needed", F.when(F.col("verdict") == "inconclusive", needed)).withColumn(
        "times_to_decide", F.when(F.col("_needed") <= limit, F.col("_needed"))).drop("_needed")


# ── which checks are judged ──────────────────────────────────────────────────

def applies(engine: str) -> Column:
    """Why a statistical test does not judge a check (null when it does).
    Reads `comparison`, `check_engine` and `recorded_answer`."""
    if engine == "trial":
        return F.lit("no_verdict_in_trial")
    if engine in SCORE_ENGINES:
        return F.when(F.col("comparison").isNull(), "no_score")
    if engine in STABILITY_ENGINES:
        return (F.when(F.col("check_engine").isNull() | (F.col("check_engine") != JUDGE_ENGINE),
                       "not_a_judge")
                .when(~F.col("recorded_answer"), "answer_varies"))
    return F.lit(None).cast("string")


def threshold_value(raw: Column) -> Column:
    """A configured threshold as a finite number, else null."""
    number = number_of(raw)
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def apply_overrides(checks: DataFrame, targets: DataFrame, left_out: DataFrame,
                    target: float) -> DataFrame:
    """Each check's own target when the batch set one, and whether it is left
    out. Keys: batch_id, entry_id (may be null), label."""
    t = targets.select(*KEYS, F.col("target").alias("_own"))
    o = left_out.select(*KEYS, F.lit(True).alias("_out"))
    return (join_on(join_on(checks, t, KEYS, "left"), o, KEYS, "left")
            .withColumn("target", F.coalesce("_own", F.lit(float(target))))
            .withColumn("left_out", F.coalesce("_out", F.lit(False))).drop("_own", "_out"))


def judge_checks(checks: DataFrame, engine: str, confidence: float, floor: int = 1) -> DataFrame:
    """Each check's verdict or the reason there is none, in order: it does not
    apply; nothing decided; stopped below the floor; no numeric threshold; too
    few scores; else the test's own verdict.

    `checks` carries the fold, `target`, `left_out`, `stopped`, catalogue
    columns, and for averages n, mean, sd, threshold, higher_passes.
    """
    average = engine == "one_sample_t"
    out = checks.withColumn("not_applied", F.when(F.col("left_out"), "left_out").otherwise(applies(engine)))
    n = F.coalesce("n", F.lit(0)) if average else F.col("evaluated")
    least = F.lit(floor) if average else gate_floor(F.col("target"), confidence)
    if average:
        out = one_sample_t(out, confidence, bounds=False)
    elif engine in STABILITY_ENGINES:
        out = agreement_gate(out, F.col("target"), confidence)
    else:
        out = gate(out, F.col("target"), confidence)
    reason = F.when(F.col("not_applied").isNotNull(), None).when(n == 0, "no_result") \
        .when(F.col("stopped") & (n < least), "stopped_below_floor")
    if average:
        reason = reason.when(F.col("threshold").isNull(), "threshold_not_number") \
            .when(n < least, "too_few_scores")
    return (out.withColumn("no_verdict", reason)
            .withColumn("verdict", F.when(F.col("not_applied").isNull() & F.col("no_verdict").isNull(),
                                          F.col("verdict"))))


# ── the batch as a whole ─────────────────────────────────────────────────────

def roll_up_batches(judged: DataFrame, runs: DataFrame, trial: bool = False) -> DataFrame:
    """Verdict tallies and status per batch. `judged` has verdict and
    not_applied per check; `runs` has status; `stopped` comes with either."""
    applicable = F.col("not_applied").isNull()
    tally = judged.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("checks_total"), F.count_if(applicable).alias("checks_applicable"),
        *[F.count_if(applicable & (F.col("verdict") == v)).alias(f"n_{v}")
          for v in ("pass", "fail", "inconclusive")],
        F.count_if(applicable & F.col("verdict").isNull()).alias("n_none"),
        F.bool_or("stopped").alias("stopped"))
    ran = runs.groupBy("batch_id").agg(F.bool_and(~_ran()).alias("nothing_ran"))
    c = F.col
    status = (F.when(c("stopped"), "Incomplete").when(c("nothing_ran"), "NotRan")
              .when(F.lit(trial), "Done")
              .when((c("checks_applicable") > 0) & (c("n_none") == c("checks_applicable")), "NotRan")
              .when(c("n_fail") > 0, "Failed")
              .when(c("n_pass") == c("checks_applicable"), "Passed").otherwise("Inconclusive"))
    # a batch without checks has a status too
    counts = [x for x in tally.columns if x.startswith(("checks_", "n_"))]
    whole = ran.join(tally, "batch_id", "left").fillna(0, counts).fillna(False, ["stopped"])
    return whole.withColumn("status", status).drop("nothing_ran")


def entry_outcomes(run_outcomes: DataFrame) -> DataFrame:
    """Runs passed and failed per entry; runs that decided nothing are out."""
    return run_outcomes.groupBy("batch_id", "entry_id").agg(
        F.count_if(F.col("run_passed")).alias("passed"),
        F.count_if(~F.col("run_passed")).alias("failed"))


def failures_by_entry(outcomes: DataFrame, confidence: float) -> DataFrame:
    """Do failures gather in some entries? Homogeneity chi-square per batch.

    With totals P, F, N the statistic is N*N/(P*F) * (sum(p*p/n) - P*P/N), so
    one pass of sums does it: no entry needs to see its batch's totals.
    """
    n = F.col("passed") + F.col("failed")
    sums = outcomes.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(n > 0).alias("counted"),
        F.sum("passed").alias("passes"), F.sum("failed").alias("fails"),
        F.sum(F.when(n > 0, F.col("passed") * F.col("passed") / n)).alias("_spread"),
        F.min(F.when(n > 0, n)).alias("_least"))
    p, f = F.col("passes").cast("double"), F.col("fails").cast("double")
    total = p + f
    tested = (F.col("counted") >= 2) & (F.col("fails") > 0) & (F.col("passes") > 0)
    chi = total * total / (p * f) * (F.col("_spread") - p * p / total)
    return (sums.filter("entries > 1")
            .withColumn("chi_square", F.when(tested, F.greatest(chi, F.lit(0.0))))
            .withColumn("df", F.when(tested, F.col("counted") - 1))
            .withColumn("p_value", F.when(tested, N.chi_square_above(F.col("chi_square"), F.col("df"))))
            .withColumn("approximate", F.coalesce(
                F.col("_least") * F.least("passes", "fails") / F.nullif(total, F.lit(0.0)) < 5, F.lit(False))
                & tested)
            .withColumn("verdict", F.when(~tested, None).when(F.col("p_value") <= 1 - confidence,
                                                              "concentrated").otherwise("no_evidence"))
            .withColumn("reason", F.when(F.col("counted") < 2, "fewer_than_two_entries")
                        .when(F.col("fails") == 0, "no_failure").when(F.col("passes") == 0, "all_failed"))
            .drop("_spread", "_least"))


def worst_entries(outcomes: DataFrame) -> DataFrame:
    """Entries by share of failed runs, worst first, then by name."""
    total = F.col("passed") + F.col("failed")
    share = F.coalesce(F.col("failed") / F.nullif(total, F.lit(0)), F.lit(0.0))
    return outcomes.withColumn("failed_share", share).orderBy("batch_id", F.desc("failed_share"), "name")


def entry_order() -> list[Column]:
    """The order entries are shown in: set name, entry name (case aside), id."""
    return [F.lower(F.coalesce("test_set_name", F.lit(""))), F.lower("name"), F.col("entry_id").cast("string")]


# ── progress ─────────────────────────────────────────────────────────────────

def _open() -> Column:
    return F.col("status").isin(*IN_FLIGHT_STATUSES)


def status_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(prefix + s.lower())
            for s in ("Pending", "Running", "Green", "Amber", "Red", "NotRan")]


STOP_REASON = "Stopped before it ran: the batch was stopped"  # fixed value: the error of a run that a stop cancelled


def batch_progress(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs by status, done and cancelled; times done (no run open) and times
    wholly cancelled by a stop; calls planned, finished and in flight.

    A run is cancelled when it did not run and its error is the stop's. Only
    Running runs have calls in flight. An ended run that no stop cancelled asked
    the application; its judge calls count unless it is NotRan. `runs`: status,
    error, `asks_app` (0/1) and `judge_checks`; `plans`: batch_id,
    times_requested, app_per_time, judge_per_time.
    """
    cancelled = (F.col("status") == "NotRan") & F.col("error").eqNullSafe(F.lit(STOP_REASON))
    running = F.col("status") == "Running"
    calls = {"app_done": (~_open() & ~cancelled, "asks_app"), "app_open": (running, "asks_app"),
             "judge_done": (~_open() & (F.col("status") != "NotRan"), "judge_checks"), "judge_open": (running, "judge_checks")}
    by_time = runs.groupBy("batch_id", "batch_index").agg(
        *status_counts("_"), F.count(F.lit(1)).alias("_runs"), F.bool_or(_open()).alias("_open"), F.count_if(~_open()).alias("_done"),
        F.count_if(cancelled).alias("_cancelled"), *[F.sum(F.when(when, F.col(c)).otherwise(0)).alias(f"_{n}") for n, (when, c) in calls.items()])
    counted = by_time.groupBy("batch_id").agg(
        F.sum("_runs").alias("runs"), F.sum("_done").alias("runs_done"), F.sum("_cancelled").alias("runs_cancelled"),
        *[F.sum(f"_{s}").alias(s) for s in ("pending", "running", "green", "amber", "red", "notran")],
        F.count_if(~F.col("_open")).alias("times_done"),
        F.count_if(F.col("_cancelled") == F.col("_runs")).alias("times_cancelled"),
        *[F.sum(f"_{c}").alias(c) for c in calls])
    planned = plans.select("batch_id", "times_requested", *[(F.col(f"{c}_per_time") * F.col("times_requested")).alias(f"{c}_planned") for c in ("app", "judge")])
    return counted.join(planned, "batch_id", "left")


def live_status(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """Pending while every run is pending, Running while any is open or waves
    are left; otherwise null: the batch can be computed. Reads
    `waves_left` from batches."""
    seen = runs.groupBy("batch_id").agg(F.bool_and(F.col("status") == "Pending").alias("_all_pending"),
                                        F.bool_or(_open()).alias("_any_open"))
    return (batches.select("batch_id", "waves_left").join(seen, "batch_id", "left")
            .select("batch_id", F.when(F.col("_all_pending"), "Pending")
                    .when(F.col("_any_open") | F.col("waves_left"), "Running").alias("live_status")))


def runs_matrix(runs: DataFrame) -> DataFrame:
    """entry x time -> status, one row per run, in time order when written
    with the keys it is sorted on inside each partition."""
    return (runs.select("batch_id", "entry_id", "batch_index", "run_id", "status")
            .repartition("batch_id", "entry_id", "batch_index")
            .sortWithinPartitions("batch_id", "entry_id", "batch_index"))


def trial_summary(folded: DataFrame, confidence: float) -> DataFrame:
    """Rates only: a trial asks no question."""
    return wilson_rates(folded, confidence).withColumn("verdict", F.lit(None).cast("string"))


def stop_batch(runs: DataFrame, batches: DataFrame, reason: str) -> DataFrame:
    """Pending runs of the given batches become NotRan with the reason."""
    hit = batches.select(F.col("batch_id").alias("_b")).distinct().withColumn("_stop", F.lit(True))
    stop = F.coalesce("_stop", F.lit(False)) & (F.col("status") == "Pending")
    return (runs.join(hit, runs["batch_id"] == hit["_b"], "left")
            .withColumn("error", F.when(stop, F.lit(reason)).otherwise(F.col("error")))
            .withColumn("status", F.when(stop, "NotRan").otherwise(F.col("status")))
            .drop("_b", "_stop"))

