"""The run life cycle as streams: newest state, stale runs, waves; progress
is counted from the table of newest states.

Results leave through `to_table`: each micro-batch overwrites its own folder,
so a replayed batch changes nothing, and a reader takes each key's newest row.
"""
from __future__ import annotations

import json
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyed import latest_per
from ..schemas import RUN_STATUSES
from ..session import shared_folder


def read_events(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    """A parquet folder as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def to_table(stream: DataFrame, mode: str, name: str) -> tuple[str, object]:
    """Runs a stream over what is there now into a table folder; returns the
    folder and the query."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/epoch={epoch}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return f"{base}/table", query


# Fixed value: what keys are dealt into where a stream calls Python. A call costs
# milliseconds whatever it is given, so it gets many keys; it stays with a
# stream's progress folder, whose state is kept under these numbers.
BUCKETS = 1024


def _bucket(*keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def newest_rows(spark: SparkSession, folder: str, keys: list[str], schema) -> DataFrame:
    """Each key's row of its newest micro-batch."""
    rows = spark.read.schema(f"{schema}, epoch long").parquet(folder)
    return latest_per(rows, keys, [F.desc("epoch")]).drop("epoch")


RUN_STATE = "run_id long, batch_id string, status string, us long"


def stream_run_state(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Newest status per run; a repeated event changes nothing, as the newest
    by (time, event) is the same whichever copy is seen. Update mode.

    A run's state goes once the watermark reaches its newest event: any event
    let in later is newer.
    """
    def newest(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = best = tuple(state.get) if state.exists else None
        for part in parts:
            top = part.sort_values(["us", "event_id"]).iloc[-1]
            if best is None or (top["us"], top["event_id"]) > best[:2]:
                best = (int(top["us"]), int(top["event_id"]), top["status"], top["batch_id"])
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if best != before:
            yield pd.DataFrame({"run_id": [key[0]], "batch_id": [best[3]], "status": [best[2]], "us": [best[0]]})

    rows = events.withWatermark("ts", late).select("run_id", "batch_id", "event_id", "status", "ts", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("run_id").applyInPandasWithState(newest, RUN_STATE, "us long, event_id long, status string, batch_id string",
                                                        "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("run_id", "batch_id", "status", F.timestamp_micros("us").alias("ts"))


def claim_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run, status) event once, however often it is delivered. Append mode."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "status"])


def progress(states: DataFrame) -> DataFrame:
    """Runs by newest status per batch, from one row per run."""
    return states.groupBy("batch_id").agg(F.count(F.lit(1)).alias("runs"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in RUN_STATUSES])


def windowed_outcomes(events: DataFrame, every: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Outcomes counted per time window: tumbling, or sliding with `slide`."""
    span = F.window("ts", every, slide) if slide else F.window("ts", every)
    return (events.withWatermark("ts", late).groupBy(span, "status").agg(F.count(F.lit(1)).alias("runs"))
            .select(F.col("window.start").alias("start"), "status", "runs"))


def stale_pending(runs: DataFrame, now, minutes: int = 15) -> DataFrame:
    """Batch form: pending runs created longer ago than the threshold."""
    return runs.filter((F.col("status") == "Pending") & (F.col("created_at") < F.lit(now) - F.make_interval(mins=F.lit(minutes))))


STALE = "run_id string, us long"


def stream_stale_pending(events: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Runs still pending when the watermark passes their start by the
    threshold: (run_id, pending_since). Append mode.

    That a run moved on is remembered until the watermark reaches its newest
    event, so a late or repeated start does not open it again; earlier events
    are too late to be let in. One state holds the open runs of a bucket.
    """
    wait = minutes * 60_000_000

    def watch(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, runs, seen = state.getCurrentWatermarkMs(), {}, set()
        if state.exists:
            runs = {run: facts for run, *facts in json.loads(state.get[0])}  # since, moved, newest, due
        if not state.hasTimedOut:
            for part in parts:
                for run, status, us in zip(part["run_id"].tolist(), part["status"].tolist(), part["us"].tolist()):
                    facts = runs.setdefault(run, [None, False, 0, 0])
                    seen.add(run)
                    if status != "Pending":
                        facts[1] = True
                    elif us == us:
                        facts[0] = int(us) if facts[0] is None else min(facts[0], int(us))
                    if us == us:
                        facts[2] = max(facts[2], int(us))
        stale = []
        for run in list(runs):
            since, moved, newest, due = runs[run]
            if run in seen and (moved or since is not None):
                runs[run][3] = max((newest if moved else since + wait) // 1000, mark) + 1
            elif run in seen or due < mark:
                del runs[run]
                if run not in seen and not moved:
                    stale.append((run, since))
        if runs:
            state.update((json.dumps([[run, *facts] for run, facts in runs.items()]),))
            state.setTimeoutTimestamp(max(min(facts[3] for facts in runs.values()), mark))
        elif state.exists:
            state.remove()
        if stale:
            yield pd.DataFrame(stale, columns=["run_id", "us"])

    rows = events.withWatermark("ts", late).select(_bucket("run_id"), F.col("run_id").cast("string").alias("run_id"), "ts", "status", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("bucket").applyInPandasWithState(watch, STALE, "runs string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("run_id").cast("long").alias("run_id"), F.timestamp_micros("us").alias("pending_since"))


DECISIONS = "batch_id string, entry_id long, label string, verdict string, at_time int, passes int, evaluated int, error string"
MEAN_DECISIONS = "batch_id string, entry_id long, label string, verdict string, at_time int, n int, mean double, sd double, error string"


def plan_problems(plans: DataFrame, means: bool = False) -> DataFrame:
    """The plans with `error`, null for plans a stream can follow. A batch with
    several rows has a plan that cannot be told."""
    looks = F.col("looks")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("looks") - 1, F.lit(1))), lambda i: F.get("looks", i).isNull() | (F.get("looks", i) > F.get("looks", i - 1)))
    aim = (F.when(F.col("threshold").isNull() | F.isnan("threshold"), "no_threshold").when(F.col("higher_passes").isNull(), "no_direction") if means else
           F.when(F.col("target").isNull() | ~((F.col("target") > 0) & (F.col("target") < 1)), "target_out_of_range"))
    error = (F.when(looks.isNull() | (F.size("looks") == 0), "no_looks").when(F.exists("looks", lambda x: x.isNull()) | (looks[0] < 1) | ~rising, "looks_not_rising")
             .when(F.col("level").isNull() | ~((F.col("level") > 0) & (F.col("level") < 1)), "level_out_of_range").otherwise(aim))
    kept_columns = [c for c in plans.columns if c != "batch_id"]
    found = plans.withColumn("error", error)
    several = F.when(F.count(F.lit(1)) > 1, "several_plans").otherwise(F.first("error"))
    return found.groupBy("batch_id").agg(*[F.first(c).alias(c) for c in kept_columns], several.alias("error"))


def _tail(k: int, n: int, p: float, above: bool) -> float:
    """Chance of k or more (or k or fewer) of n: from the term at k outward each
    term is its neighbour's times a ratio, until nothing is added."""
    if above and k <= 0 or not above and k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    if (k < n * p) == above:  # the long side: one less the short one
        return 1.0 - _tail(k - 1 if above else k + 1, n, p, not above)
    term = total = math.exp(log)
    while term > 1e-18 * total and (k < n if above else k > 0):
        term *= (n - k) / (k + 1) * p / (1 - p) if above else k / (n - k + 1) * (1 - p) / p
        k += 1 if above else -1
        total += term
    return min(total, 1.0)


def _t_tails(t: float, df: int) -> tuple[float, float]:
    """Chances of more and of less than t on `df` degrees of freedom: Simpson's
    rule over the angle whose tangent is t / sqrt(df)."""
    angle, steps = abs(math.atan2(t, math.sqrt(df))), 400
    # the half line has area 1 / (2 * whole); beyond eight widths of the cosine nothing is left
    h = min(angle, 12 / math.sqrt(df)) / steps
    area = h / 3 * float(_SIMPSON @ np.cos(_STEPS * h) ** (df - 1))
    whole = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    half = max(0.5 - whole * area, 0.0)
    return (half, 1 - half) if t >= 0 else (1 - half, half)


def _t_above(t: float, df: int) -> float:
    return _t_tails(t, df)[0]


_STEPS = np.arange(401.0)
_SIMPSON = np.where(_STEPS % 2 == 1, 4.0, 2.0)
_SIMPSON[[0, -1]] = 1.0


class _Waves:
    """The checks of one bucket: their names, how many waves are judged, whether
    they are closed, when they may go, their sums; and as arrays, sorted by check
    and time, the times of waves still open with the value each result counts
    for, not a number where it counts for nothing. A micro-batch costs array
    operations for its results and a few steps for each check it brings."""

    def __init__(self, held: bytes | None, empty: tuple, kind: type):
        self.empty, self.kind = empty, kind
        names, self.done, self.closed, self.until, self.sums, sizes, times, values = pickle.loads(held) if held else ([], [], [], [], [], *[np.zeros(0, np.int64)] * 3)
        self.places = {name: i for i, name in enumerate(names)}
        self.who, self.times, self.values = np.repeat(np.arange(len(names)), sizes), times.astype(np.int64), values.astype(float)

    def place(self, name: tuple) -> int:
        i = self.places.setdefault(name, len(self.places))
        if i == len(self.done):
            for part, first in ((self.done, 0), (self.closed, False), (self.until, None), (self.sums, self.empty)):
                part.append(first)
        return i

    def take(self, who: np.ndarray, times: np.ndarray, values: np.ndarray) -> None:
        """Adds results; of equal times of a check the first one counts."""
        who, times, values = (np.concatenate(x) for x in ((self.who, who), (self.times, times), (self.values, values)))
        order = np.lexsort((times, who))  # stable, so what came first stays first
        who, times, values = who[order], times[order], values[order]
        new = np.append(True, (who[1:] != who[:-1]) | (times[1:] != times[:-1]))[:len(who)]
        self.who, self.times, self.values = who[new], times[new], values[new]

    def drop(self, judged: np.ndarray) -> None:
        """Lets go of results of waves that are judged, by place in the arrays,
        and of all results of closed checks."""
        kept = ~(judged | np.array(self.closed, bool)[self.who])
        self.who, self.times, self.values = self.who[kept], self.times[kept], self.values[kept]

    def held(self, now: int | None) -> bytes | None:
        """All this as bytes, without checks whose time has come."""
        stays = [i for i, until in enumerate(self.until) if now is None or until is None or until > now]
        if not stays:
            return None
        names, sizes = list(self.places), np.bincount(self.who, minlength=len(self.done))
        on = np.isin(self.who, stays) if len(stays) < len(names) else slice(None)
        small = np.int32 if not len(self.times) or self.times.max() < 1 << 31 else np.int64
        return pickle.dumps(([names[i] for i in stays], *[[part[i] for i in stays] for part in (self.done, self.closed, self.until, self.sums)],
                             sizes[stays].astype(np.int32), self.times[on].astype(small), self.values[on].astype(self.kind)), 5)


def _decided(results: DataFrame, plans: DataFrame, value: str, empty: tuple, shape: str, judge, keep: list[str], idle: str | None) -> DataFrame:
    """One decision a check, by `judge(sums, wave, row)` on complete waves, which
    gives the new sums too. A bad plan gives each of its checks one row with the
    error. One state holds the checks of a bucket, each with the time at which
    it may go."""
    names = [c.split()[0] for c in shape.split(", ")]
    check, facts_of = ["batch_id", "entry_id", "label"], ["level", *keep]
    whole = {c: "Int32" for c in ("at_time", "passes", "evaluated", "n") if c in names}
    rest = results.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + interval {idle})")).first()[0] if idle else None
    small = np.float16 if value == "passed" else np.float64  # holds 0, 1 and none

    def run(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, out = held.getCurrentProcessingTimeMs(), []
        waves = _Waves(held.get[0] if held.exists else None, empty, small)
        rows = pd.concat(parts, ignore_index=True) if not held.hasTimedOut else None
        if rows is not None and len(rows):
            codes = np.zeros(len(rows), np.int64)
            for c in check:
                own = pd.factorize(rows[c])[0] + 1
                codes = np.unique(codes * (own.max() + 1) + own, return_inverse=True)[1]
            first = np.unique(codes, return_index=True)[1]
            facts = rows.iloc[first].to_dict("list")
            at = np.array([waves.place(name) for name in zip(*[facts[c] for c in check])])
            looks, edge, last = [], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for j, i in enumerate(at):
                bad = isinstance(facts["error"][j], str)
                plan = [] if bad or waves.closed[i] else [int(x) for x in facts["looks"][j].split(",")]
                looks.append(plan)
                if bad and not waves.closed[i]:
                    waves.closed[i] = True
                    out.append((*[facts[c][j] for c in check], *[None] * (len(names) - 4), facts["error"][j]))
                if plan:
                    edge[j], last[j] = plan[waves.done[i] - 1] if waves.done[i] else 0, plan[-1]
            times, counts = rows["batch_index"].to_numpy(np.int64), rows[value].to_numpy(float, na_value=np.nan)
            counts = np.where(rows["errored"].to_numpy(bool), np.nan, counts)
            open_ = (edge[codes] < times) & (times <= last[codes])
            waves.take(at[codes[open_]], times[open_], counts[open_])
            starts, ends = (np.searchsorted(waves.who, at, side) for side in ("left", "right"))
            judged = np.zeros(len(waves.who), bool)
            for j, i in enumerate(at):
                plan, start = looks[j], starts[j]
                row = {c: facts[c][j] for c in facts_of}
                while plan and not waves.closed[i]:
                    # times differ, lie beyond the edge and are in order, so a wave is complete when the one at its size is its last
                    size = plan[waves.done[i]] - (plan[waves.done[i] - 1] if waves.done[i] else 0)
                    if start + size > ends[j] or waves.times[start + size - 1] != plan[waves.done[i]]:
                        break
                    wave = waves.values[start:start + size]
                    judged[start:start + size] = True
                    start += size
                    waves.done[i] += 1
                    waves.sums[i], found, verdict = judge(waves.sums[i], wave[~np.isnan(wave)].tolist(), row)
                    if verdict or waves.done[i] == len(plan):
                        waves.closed[i] = True
                        out.append((*[facts[c][j] for c in check], verdict, plan[waves.done[i] - 1] if verdict else None, *found, None))
            waves.drop(judged)
            if rest is not None:
                for i in at:
                    waves.until[i] = now + rest if waves.closed[i] else None
        bytes_ = waves.held(now if rest is not None else None)
        if bytes_:
            held.update((bytes_,))
            going = [until for until in waves.until if until is not None and until > now]
            if going:
                held.setTimeoutDuration(min(going) - now)
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=names).astype(whole)

    # looks are sent as text: an array a row would cost more than all the rest of it
    text = F.concat_ws(",", F.col("looks").cast("array<string>")).alias("looks")
    planned = results.join(plans.select("batch_id", "looks", "level", *keep, "error"), "batch_id").filter(F.col("batch_index").isNotNull())
    rows = planned.select(_bucket(*check), "batch_id", F.col("entry_id").cast("string").alias("entry_id"), "label", "batch_index", value, F.coalesce("errored", F.lit(False)).alias("errored"), text, "level", *keep, "error")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    out = rows.groupBy("bucket").applyInPandasWithState(run, shape.replace("entry_id long", "entry_id string"), "checks binary", "append", timeout)
    return out.withColumn("entry_id", F.col("entry_id").cast("long"))


def stream_sequential(results: DataFrame, plans: DataFrame, agreement: bool = False, idle: str | None = None) -> DataFrame:
    """Each check's decision, once, when a wave is complete; it never changes.
    A check that no look decides comes out undecided after the last. Append mode.

    `plans` is a table: batch_id, looks (int array), level, target; results of
    other batches are no business of this stream, and a plan that cannot be
    followed gives its checks one row each with the error. With `agreement`,
    the runs that gave the usual verdict count. A replayed result changes
    nothing: the times seen of the waves still open are state, at most as many
    as a batch has times, and a result of a wave already judged is late and
    ignored. What stays of a decided check is its name and empty lists; with
    `idle`, such as '30 days', it goes after that time without results.
    """
    def judge(sums: tuple, wave: list, row) -> tuple[tuple, tuple, str | None]:
        n, k = sums[0] + len(wave), sums[1] + int(sum(wave))
        counted, verdict, alpha = max(k, n - k) if agreement else k, None, 1 - float(row["level"])
        if n:
            p = float(row["target"])
            verdict = "pass" if _tail(counted, n, p, True) <= alpha else "fail" if _tail(counted, n, p, False) <= alpha else None
        return (n, k), (counted, n), verdict

    return _decided(results, plan_problems(plans), "passed", (0, 0), DECISIONS, judge, ["target"], idle)


def stream_sequential_means(results: DataFrame, plans: DataFrame, idle: str | None = None) -> DataFrame:
    """The same for averages. `plans`: batch_id, looks, level, threshold,
    higher_passes; `results` has `score`. The state holds the number of scores,
    their mean, the sum of squares about it and both ends; a wave's own moments
    are merged in, so no score is kept once its wave is judged. A look needs
    two scores; equal scores decide by themselves."""
    def judge(sums: tuple, wave: list, row) -> tuple[tuple, tuple, str | None]:
        n, mean, spread, low, high = sums
        if wave:
            m = math.fsum(wave) / len(wave)
            shift, both = m - mean, n + len(wave)
            spread += math.fsum((x - m) ** 2 for x in wave) + shift * shift * n * len(wave) / both
            mean += shift * len(wave) / both
            n, low, high = both, min(low, *wave), max(high, *wave)
        sums = (n, mean, spread, low, high)
        if n < 2:
            return sums, (n, None, None), None
        alpha, threshold, higher = 1 - float(row["level"]), float(row["threshold"]), bool(row["higher_passes"])
        if low == high:
            return sums, (n, low, 0.0), "pass" if (low >= threshold if higher else low <= threshold) else "fail"
        sd = math.sqrt(spread / (n - 1))
        t = (mean - threshold) / (sd / math.sqrt(n)) * (1 if higher else -1)
        above, below = _t_tails(t, n - 1)
        return sums, (n, mean, sd), "pass" if above <= alpha else "fail" if below <= alpha else None

    return _decided(results, plan_problems(plans, True), "score", (0, 0.0, 0.0, math.inf, -math.inf), MEAN_DECISIONS, judge, ["threshold", "higher_passes"], idle)
