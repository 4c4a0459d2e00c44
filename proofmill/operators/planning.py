"""How many runs a question needs, judged from what earlier runs showed."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.numeric import let, log_factorial
from ..schemas import EVALUATED_STATUSES, JUDGE_ENGINE, MAX_RUNS, MAX_TIMES
from .batch import runs_allowing
from .fanout import CONTENT, _comparable
from .keyed import newest_per, spread

# Fixed values
HISTORY_RUNS = 200
STANDALONE_SCAN = 1000
GOAL = 0.9
WITHIN = 0.05
LIKELY = 0.9
TARGET_STEP = 0.05
CONFIDENCE_STEPS = (0.999, 0.99, 0.95, 0.9, 0.85, 0.8)
LEAST_GAIN = 0.005  # what a change must add to the best chance to be worth a mention
LEAST_UNDECIDED = 0.05  # below it every check is almost sure to be told
SCORE_SIZES = (10, 15, 20, 25, 30, 40, 50, 60, 75, 100, 125, 150, 200, 250, 300, 400, 500, 600, 750, 1000)


# ── history ──────────────────────────────────────────────────────────────────

def check_history(runs: DataFrame, results: DataFrame, limit: int = HISTORY_RUNS) -> DataFrame:
    """Each check's results over the newest evaluated runs of its entry. The
    run limit is applied per task before the shuffle; results meet only the
    runs kept."""
    newest = newest_per(runs.filter(F.col("status").isin(*EVALUATED_STATUSES)).select("entry_id", "run_id", "executed_at"), "entry_id",
                        [F.desc("executed_at"), F.desc("run_id")], limit).select("run_id")
    kept = results.join(newest, "run_id", "left_semi").filter(~F.col("errored") & F.col("passed").isNotNull())
    return kept.groupBy("entry_id", "label").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count("score").alias("scores"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))


def standalone_history(runs: DataFrame, copies: DataFrame, tests: DataFrame, limit: int = HISTORY_RUNS, scan: int = STANDALONE_SCAN) -> DataFrame:
    """The newest runs of each test whose frozen copy asked what the test asks
    now, out of its newest `scan` runs: (test_id, run_id)."""
    evaluated = runs.filter(F.col("test_id").isNotNull() & F.col("status").isin(*EVALUATED_STATUSES)).select("test_id", "run_id", "executed_at")
    scanned = newest_per(evaluated, "test_id", [F.desc("executed_at"), F.desc("run_id")], scan)
    now = tests.select("test_id", *[F.col(c).alias(f"_{c}") for c in CONTENT], _comparable(F.col("assignments")).alias("_checks"))
    then = copies.select("run_id", *CONTENT, _comparable(F.col("assignments")).alias("checks"))
    same = F.col("checks").eqNullSafe(F.col("_checks"))
    for c in CONTENT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    matching = scanned.join(then, "run_id").join(now, "test_id").filter(same).select("test_id", "run_id", "executed_at")
    return newest_per(matching, "test_id", [F.desc("executed_at"), F.desc("run_id")], limit).select("test_id", "run_id")


# ── chances ──────────────────────────────────────────────────────────────────

def _passes_at_least(k: Column, n: Column, passed: Column, failed: Column) -> Column:
    """P(at least k of n runs pass) when the history leaves the rate as
    Beta(passed + 1, failed + 1).

    With whole counts this is a tail of the hypergeometric: shuffle the n runs
    among passed + failed + 1 markers; k runs come before marker passed + 1
    exactly when the first k + passed places hold at most `passed` markers.
    The shorter side is summed, so a record with few failures costs a few
    terms at any n.
    """
    state = F.struct(*[c.cast("double").alias(x) for x, c in (
        ("n", n), ("m", k + passed), ("all", passed + failed + 1), ("a", passed), ("b", failed))])

    def term(s, j):
        return F.exp(log_factorial(s["all"]) - log_factorial(j) - log_factorial(s["all"] - j) + log_factorial(s["n"])
                     - log_factorial(s["m"] - j) - log_factorial(s["n"] - s["m"] + j) - log_factorial(s["n"] + s["all"])
                     + log_factorial(s["m"]) + log_factorial(s["n"] + s["all"] - s["m"]))

    def walk(first, count, ratio):
        def step(t, _):
            return let(t["p"] * ratio(t["j"]), lambda p: F.struct(t["j"].alias("j"), p.alias("p"), (t["sum"] + p).alias("sum")))
        start = let(first["p"], lambda p: F.struct(first["j"].alias("j"), p.alias("p"), p.alias("sum")))
        return F.when(count < 1, first["p"]).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1))), start,
            lambda t, i: let(step(t, i), lambda x: F.struct((x["j"] + first["move"]).alias("j"), x["p"].alias("p"), x["sum"].alias("sum"))))["sum"])

    def above(s):  # markers a+1 .. all: one term per failure and one more
        return let(F.struct((s["a"] + 1).alias("j"), term(s, s["a"] + 1).alias("p"), F.lit(1.0).alias("move")), lambda f: 1 - walk(
            f, s["b"], lambda j: (s["all"] - j) * (s["m"] - j) / ((j + 1) * (s["n"] - s["m"] + j + 1))))

    def below(s):  # markers a .. 0
        return let(F.struct(s["a"].alias("j"), term(s, s["a"]).alias("p"), F.lit(-1.0).alias("move")), lambda f: walk(
            f, s["a"], lambda j: j * (s["n"] - s["m"] + j) / ((s["all"] - j + 1) * (s["m"] - j + 1))))

    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(let(state, lambda s: F.when(s["b"] <= s["a"], above(s)).otherwise(below(s))))


def answer_chance(history: DataFrame, rules: DataFrame) -> DataFrame:
    """The chance that n runs pass, fail or stay undecided, for each distinct
    (passed, failed, target) of `history` at each rule size. Histories hold at
    most 200 runs, so distinct shapes are few however many checks there are.
    No history counts as none passed and none failed. Where scopes mix targets
    the rules come from `size_grid`."""
    none = {"passed": 0, "failed": 0}
    shapes = history.select("passed", "failed", "target").fillna(none).distinct()
    at = spread(shapes.join(rules if "peak" in rules.columns else rules.withColumn("peak", F.lit(True)), "target"))
    def from_(k):
        return _passes_at_least(k, F.col("n"), F.col("passed"), F.col("failed"))
    passes = F.when(F.col("pass_at_least").isNull(), 0.0).otherwise(from_(F.col("pass_at_least")))
    fails = F.when(F.col("fail_at_most").isNull(), 0.0).otherwise(1 - from_(F.col("fail_at_most") + 1))
    return (at.withColumn("passes", F.greatest(F.lit(0.0), F.least(F.lit(1.0), passes))).withColumn("fails", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fails)))
            .withColumn("answer", F.col("passes") + F.col("fails")).withColumn("undecided", F.greatest(F.lit(0.0), 1 - F.col("answer"))))


def mean_answer_chance(checks: DataFrame, confidence: float) -> DataFrame:
    """The same for an average, by the normal approximation. Reads n, mean, sd,
    scores (history size), threshold, higher_passes."""
    c = F.col
    gap = F.when(c("higher_passes"), c("mean") - c("threshold")).otherwise(c("threshold") - c("mean"))
    usable = (c("n") >= 2) & (c("scores") >= 1)
    out = checks.withColumn("_gap", gap).withColumn("_bound", F.when(usable & (c("sd") > 0), N.t_quantile(confidence, c("n") - 1) * c("sd") / F.sqrt("n"))) \
        .withColumn("_spread", c("sd") * F.sqrt(1 / c("n") + 1 / c("scores")))
    def side(sign):
        flat = F.when(sign * c("_gap") > 0, 1.0).otherwise(0.0)
        return F.when(~usable, 0.0).when(c("sd") <= 0, flat).otherwise(N.normal_above((c("_bound") - sign * c("_gap")) / c("_spread")))
    return out.withColumn("passes", side(1)).withColumn("fails", side(-1)).drop("_gap", "_bound", "_spread")


def rate_at_least(passed: Column, failed: Column, target: Column) -> Column:
    """The chance the true rate reaches the target, given the history."""
    return N.beta_above(passed.cast("double") + 1, failed.cast("double") + 1, target)


def sizes(rules: DataFrame) -> DataFrame:
    """Sizes worth considering: where one more failure becomes allowed."""
    return runs_allowing(rules).select("target", "n")


def size_grid(rules: DataFrame) -> DataFrame:
    """The rules of every target at every size that is a peak of any of them;
    `peak` says of which. A scope is planned at the peaks of its own targets,
    and there every check of it needs its chance."""
    peaks = sizes(rules).withColumn("_peak", F.lit(True))
    at = rules.join(peaks.select("n").distinct(), "n").join(peaks, ["target", "n"], "left")
    return at.withColumn("peak", F.col("_peak").isNotNull()).drop("_peak")


def score_sizes(floor: int, limit: int) -> tuple[int, ...]:
    return tuple(sorted({n for n in (floor, *SCORE_SIZES) if floor <= n <= limit}))


# ── the plan of a batch ──────────────────────────────────────────────────────

def _shapes(checks: DataFrame) -> DataFrame:
    """Equal checks of a scope counted once: scope_id, passed, failed, target, certain, m."""
    return checks.fillna({"passed": 0, "failed": 0}).groupBy("scope_id", "passed", "failed", "target", "certain").agg(F.count(F.lit(1)).alias("m"))


def _logs(shaped: DataFrame, chances: DataFrame) -> DataFrame:
    """Per (scope, size): the log of the product of answer chances, zeros apart,
    and for how many checks the size is a peak. A certain check is answered."""
    at = shaped.join(chances, ["passed", "failed", "target"]).withColumn("answer", F.when(F.col("certain"), 1.0).otherwise(F.col("answer")))
    return at.groupBy("scope_id", "n").agg(
        F.sum(F.when(F.col("answer") > 0, F.col("m") * F.ln("answer")).otherwise(0.0)).alias("log"),
        F.sum(F.when(F.col("answer") > 0, 0).otherwise(F.col("m"))).alias("zeros"),
        F.sum(F.when(F.col("peak"), F.col("m")).otherwise(0)).alias("peaks"))


def odds_curve(checks: DataFrame, chances: DataFrame) -> DataFrame:
    """(scope_id, n, chance): the chance every check gets an answer, at every
    size that is a peak of one of the scope's targets."""
    return _logs(_shapes(checks), chances).filter("peaks > 0").select("scope_id", "n", F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp("log")).alias("chance"))


def plan(curve: DataFrame, keys: list[str] = ["scope_id"]) -> DataFrame:
    """The first size that reaches the goal, the best size, and when none
    reaches it the smallest within five points of the best."""
    got = curve.groupBy(*keys).agg(
        F.min(F.when(F.col("chance") >= GOAL, F.col("n"))).alias("reaches"),
        F.array_sort(F.collect_list(F.struct("n", "chance"))).alias("_c"))  # at most one point per size
    upto = F.filter("_c", lambda p: F.col("reaches").isNull() | (p["n"] <= F.col("reaches")))
    best = F.array_max(F.transform(upto, lambda p: F.struct(p["chance"].alias("chance"), (-p["n"]).alias("neg"))))
    out = got.withColumn("_best", best).withColumn("best", -F.col("_best.neg")).withColumn("best_chance", F.col("_best.chance"))
    worth = F.get(F.filter("_c", lambda p: p["chance"] >= F.col("best_chance") - WITHIN), F.lit(0))["n"]
    out = out.withColumn("worth", F.when(F.col("reaches").isNull(), worth)).withColumn("times", F.coalesce("reaches", "worth"))
    return out.withColumn("chance", F.get(F.filter("_c", lambda p: p["n"] == F.col("times")), F.lit(0))["chance"]).select(
        *keys, "reaches", "best", "best_chance", "worth", "times", "chance")


def outcome_split(checks: DataFrame, chances: DataFrame, planned: DataFrame) -> DataFrame:
    """How a batch of each scope's planned size would most likely end, and the
    check most likely to stay undecided (none when all are almost sure). A
    certain check ends as its history mostly did; there is no split while one
    has no history."""
    at = _shapes(checks).join(planned.select("scope_id", F.col("times").alias("n")), "scope_id").join(chances, ["passed", "failed", "target", "n"])
    sure, runs = F.col("certain"), F.col("passed_runs") + F.col("failed_runs")
    at = at.withColumnsRenamed({"passed": "passed_runs", "failed": "failed_runs"})
    lost = F.col("passed_runs") * 2 < runs
    at = (at.withColumn("passes", F.when(sure, F.when(lost, 0.0).otherwise(1.0)).otherwise(F.col("passes")))
          .withColumn("fails", F.when(sure, F.when(lost, 1.0).otherwise(0.0)).otherwise(F.col("fails")))
          .withColumn("undecided", F.when(sure, 0.0).otherwise(F.col("undecided"))))
    def product(c):
        zero = F.sum(F.when(c > 0, 0).otherwise(F.col("m")))
        return F.when(zero > 0, 0.0).otherwise(F.exp(F.sum(F.when(c > 0, F.col("m") * F.ln(c)).otherwise(0.0))))
    shape = F.struct(F.col("passed_runs").alias("passed"), F.col("failed_runs").alias("failed"), "target")
    split = at.groupBy("scope_id", "n").agg(product(F.col("passes")).alias("passed"), (1 - product(1 - F.col("fails"))).alias("failed"),
                                            F.bool_or(sure & (runs == 0)).alias("_unseen"), F.max(F.struct("undecided", shape.alias("shape"))).alias("_u"))
    first = checks.filter(~F.col("certain")).fillna({"passed": 0, "failed": 0}).groupBy("scope_id", "passed", "failed", "target").agg(F.min("label").alias("likely_undecided"))
    first = first.select(F.col("scope_id").alias("_s"), F.struct("passed", "failed", "target").alias("_shape"), "likely_undecided")
    out = split.join(first, (F.col("scope_id") == F.col("_s")) & (F.col("_u.shape") == F.col("_shape")), "left")
    seen = lambda c: F.when(~F.col("_unseen"), c)
    return out.select("scope_id", "n", seen(F.col("passed")).alias("passed"), seen(F.col("failed")).alias("failed"),
                      seen(F.greatest(F.lit(0.0), 1 - F.col("passed") - F.col("failed"))).alias("inconclusive"),
                      F.when(F.col("_u.undecided") >= LEAST_UNDECIDED, F.col("likely_undecided")).alias("likely_undecided"))


def outlook(checks: DataFrame) -> DataFrame:
    """Each check before running: certain, unknown, likely_pass, likely_fail or
    too_close. Reads certain, passed, failed (null without history), target."""
    runs = F.coalesce("passed", F.lit(0)) + F.coalesce("failed", F.lit(0))
    likely = rate_at_least(F.coalesce("passed", F.lit(0)), F.coalesce("failed", F.lit(0)), F.col("target"))
    return (checks.withColumn("_likely", F.when(~F.col("certain") & (runs > 0), likely))
            .withColumn("outlook", F.when(F.col("certain"), "certain").when(runs == 0, "unknown").when(F.col("_likely") >= LIKELY, "likely_pass")
                        .when(F.col("_likely") <= 1 - LIKELY, "likely_fail").otherwise("too_close")).drop("_likely"))


def lower_targets(target: Column, minimum: float) -> Column:
    """Up to three lower targets, five points apart."""
    steps = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.round(target - i * TARGET_STEP, 4))
    return F.filter(steps, lambda t: t >= minimum - 1e-9)


def less_sure(confidence: float, minimum: float) -> float | None:
    """The next lower level of confidence a batch may ask for."""
    return next((c for c in CONFIDENCE_STEPS if minimum - 1e-9 <= c < confidence - 1e-9), None)


def _helping(changed: DataFrame, planned: DataFrame) -> DataFrame:
    """Changed plans that reach the goal with fewer runs, reach it where
    nothing did, or raise the best chance."""
    found = planned.select("scope_id", F.col("reaches").alias("_reaches"), F.col("best_chance").alias("_best"))
    helps = F.when(F.col("reaches").isNotNull(), F.col("_reaches").isNull() | (F.col("reaches") < F.col("_reaches"))).otherwise(
        F.col("_reaches").isNull() & (F.col("best_chance") > F.col("_best") + LEAST_GAIN))
    return changed.join(found, "scope_id").filter(helps).drop("_reaches", "_best")


def less_sure_options(checks: DataFrame, chances: DataFrame, planned: DataFrame, confidence: float) -> DataFrame:
    """Scopes that a lower confidence helps; `chances` are those at `confidence`."""
    return _helping(plan(odds_curve(checks, chances)), planned).select(
        "scope_id", F.lit("less_sure").alias("kind"), F.lit(confidence).alias("new_confidence"), "reaches", "best_chance", "times", "chance")


def cheaper_options(checks: DataFrame, chances: DataFrame, planned: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Changes to one kind of check that help: a lower target for one check, or
    leaving one out.

    `chances` must hold every lower target too (`size_grid`). A changed scope is
    its total minus the check plus the changed check, so no scope is built
    again; equal checks of a scope give one option.
    """
    shaped = _shapes(checks)
    totals = _logs(shaped, chances)
    many = F.sum("m").over(W.partitionBy("scope_id"))
    # options are distinct shapes of a scope (bounded by the history limit), not its checks
    base = shaped.withColumn("_checks", many).filter(~F.col("certain"))
    own = chances.select("passed", "failed", F.col("target").alias("_t"), "n", F.col("answer").alias("_new"), F.col("peak").alias("_new_peak"))
    mine = chances.select("passed", "failed", "target", "n", F.col("answer").alias("_old"), F.col("peak").alias("_old_peak"))
    lowered = base.withColumn("_t", F.explode(lower_targets(F.col("target"), minimum))).withColumn("kind", F.lit("lower_target"))
    left = base.filter("_checks > 1").withColumn("_t", F.col("target")).withColumn("kind", F.lit("leave_out"))
    options = lowered.unionByName(left)
    points = (options.join(mine, ["passed", "failed", "target"]).join(totals, ["scope_id", "n"]).join(own, ["passed", "failed", "_t", "n"]))
    lower = F.col("kind") == "lower_target"
    points = points.filter((F.col("peaks") > F.col("_old_peak").cast("int")) | (lower & F.col("_new_peak")))
    zeros = F.col("zeros") - F.when(F.col("_old") > 0, 0).otherwise(1)
    log = F.col("log") - F.when(F.col("_old") > 0, F.ln("_old")).otherwise(0.0)
    new = F.when(lower, F.col("_new")).otherwise(1.0)
    chance = F.when((zeros > 0) | (new <= 0), 0.0).otherwise(F.exp(log + F.ln(new)))
    keys = ["scope_id", "kind", "passed", "failed", "target", "_t"]
    changed = plan(points.select(*keys, "n", chance.alias("chance")), keys)
    return _helping(changed, planned).select(
        "scope_id", "kind", "passed", "failed", "target", F.when(lower, F.col("_t")).alias("new_target"),
        "reaches", "best_chance", "times", "chance")


def fewest_left_out(checks: DataFrame, chances: DataFrame) -> DataFrame:
    """The fewest checks to leave out together, hardest first, for the rest to
    reach the goal, in scopes that do not reach it whole; one check at least
    stays, a certain one if there is any. Per (scope, left_out, times).

    Equal checks sit together in the order, so the running product goes over
    distinct shapes, and how many of the last shape go is one division.
    """
    every = _shapes(checks)
    shaped = every.filter(~F.col("certain")).drop("certain")
    alone = chances.filter("peak").groupBy("passed", "failed", "target").agg(F.max("answer").alias("_alone"))
    at = shaped.join(alone, ["passed", "failed", "target"]).join(chances, ["passed", "failed", "target"])
    certain = every.filter("certain").join(chances.filter("peak"), ["passed", "failed", "target"]).select("scope_id", "n", F.lit(True).alias("_sure")).distinct()
    order = [F.col("_alone"), F.col("target"), F.col("passed"), F.col("failed")]
    rest = W.partitionBy("scope_id", "n").orderBy(*[o.desc() for o in order]).rowsBetween(W.unboundedPreceding, -1)
    all_of = W.partitionBy("scope_id", "n")
    log = F.when(F.col("answer") > 0, F.ln("answer")).otherwise(-1e9)
    placed = (at.withColumn("_log", log).withColumn("_easier", F.coalesce(F.sum(F.col("m") * F.col("_log")).over(rest), F.lit(0.0)))
              .withColumn("_easier_n", F.coalesce(F.sum("m").over(rest), F.lit(0))).withColumn("_total", F.sum("m").over(all_of))
              .withColumn("_easier_peak", F.coalesce(F.max("peak").over(rest), F.lit(False))))
    goal = math.log(GOAL)
    # of this shape, the most that may stay beside everything easier
    stay = F.when(F.col("_easier") < goal - 1e-12, -1).when(F.col("_log") >= -1e-15, F.col("m")).otherwise(
        F.least(F.col("m"), F.floor((goal - F.col("_easier")) / F.col("_log") + 1e-9)))
    kept = (placed.withColumn("_stay", stay).filter("_stay >= 0").withColumn("_kept", F.col("_easier_n") + F.col("_stay")).filter("_kept >= 1")
            .join(certain, ["scope_id", "n"], "left").filter(F.col("_easier_peak") | (F.col("peak") & (F.col("_stay") > 0)) | F.col("_sure"))
            .select("scope_id", "n", "_kept", "_total"))
    # beside certain checks every other one may go
    none = certain.join(shaped.groupBy("scope_id").agg(F.sum("m").alias("_total")), "scope_id").select("scope_id", "n", F.lit(0).cast("long").alias("_kept"), "_total")
    fewest = F.min(F.struct((F.col("_total") - F.col("_kept")).alias("left_out"), F.col("n").alias("times")))
    return kept.unionByName(none).groupBy("scope_id").agg(fewest.alias("_b")).select("scope_id", "_b.left_out", "_b.times").filter("left_out > 0")


# ── cost and warnings ────────────────────────────────────────────────────────

def resolve_scope(entries: DataFrame, links: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Every entry of every scope: of each set, of each plan through its sets,
    and, with `tests` (test_id, name, model_output, assignments), of each test
    alone: itself."""
    of_set = entries.filter("test_set_id is not null").withColumn("scope_kind", F.lit("test_set")).withColumn("scope_id", F.col("test_set_id"))
    of_plan = links.select("test_set_id", F.col("plan_id").alias("scope_id")).join(entries.drop("plan_id") if "plan_id" in entries.columns else entries, "test_set_id") \
        .withColumn("scope_kind", F.lit("test_plan"))
    keep = ["scope_kind", "scope_id", "entry_id", "name", "model_output", "assignments"]
    out = of_set.select(*keep).unionByName(of_plan.select(*keep))
    if tests is None:
        return out
    alone = tests.select(F.lit("test").alias("scope_kind"), F.col("test_id").alias("scope_id"), F.col("test_id").alias("entry_id"), "name", "model_output", "assignments")
    return out.unionByName(alone)


def estimate_cost(scope_entries: DataFrame, types: DataFrame, times: int) -> DataFrame:
    """Runs and calls per time and in all for the times asked for. A count no
    batch may have is named in `problem` and never lowered."""
    judge = types.filter(F.col("engine") == JUDGE_ENGINE).select(F.col("name").alias("_name"), F.lit(1).alias("_judge"))
    checks = scope_entries.select("scope_kind", "scope_id", "entry_id", F.col("model_output").isNull().alias("_asks"),
                                  F.explode_outer("assignments.name").alias("_name")).join(judge, "_name", "left")
    per_entry = checks.groupBy("scope_kind", "scope_id", "entry_id").agg(F.first("_asks").alias("_asks"), F.count("_judge").alias("_judges"))
    per = per_entry.groupBy("scope_kind", "scope_id").agg(
        F.count(F.lit(1)).alias("runs_per_time"), F.count_if("_asks").alias("application_per_time"), F.sum("_judges").alias("judge_per_time"))
    problem = F.when(F.lit(times > MAX_TIMES), "too_many_times").when(F.col("runs_per_time") * times > MAX_RUNS, "too_many_runs")
    return per.withColumn("times", F.lit(times).cast("long")).withColumn("problem", problem).withColumns({
        "runs_total": F.col("times") * F.col("runs_per_time"), "application_total": F.col("times") * F.col("application_per_time"),
        "judge_total": F.col("times") * F.col("judge_per_time")})


def scope_warnings(scope_entries: DataFrame, types: DataFrame, engine: str) -> DataFrame:
    """(scope, code, count): entries with a recorded answer, those of them no
    check of which can vary, and checks the test does not judge."""
    from .batch import applies
    facts = types.select(F.col("name").alias("_name"), "comparison", F.col("engine").alias("check_engine"))
    checks = scope_entries.select("scope_kind", "scope_id", "entry_id", F.col("model_output").isNotNull().alias("recorded_answer"),
                                  F.explode_outer("assignments").alias("a")).withColumn("_name", F.col("a.name")).join(facts, "_name", "left")
    per_entry = checks.groupBy("scope_kind", "scope_id", "entry_id").agg(
        F.first("recorded_answer").alias("recorded"), F.coalesce(F.bool_or(F.col("check_engine") == JUDGE_ENGINE), F.lit(False)).alias("judged"),
        F.count_if(F.col("a").isNotNull() & applies(engine).isNotNull()).alias("not_judged"))
    per = per_entry.groupBy("scope_kind", "scope_id").agg(
        F.count_if("recorded").alias("recorded_answers"), F.count_if(F.col("recorded") & ~F.col("judged")).alias("nothing_can_vary"),
        F.sum("not_judged").alias("checks_not_applicable"))
    return per.unpivot(["scope_kind", "scope_id"], ["recorded_answers", "nothing_can_vary", "checks_not_applicable"], "code", "count").filter("count > 0")
