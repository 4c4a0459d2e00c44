"""Secret scans: three base patterns, and a character network over every candidate.

Candidates are runs of 16 or more of `A-Za-z0-9+/_.=-` that hold a digit. The
network reads the whole candidate and `CONTEXT` characters on either side:
one convolution over character classes, the strongest answer of each filter
inside the candidate and beside it, then a logistic output. It learns from
all different candidates of all documents, labelled by the base patterns, and
from a fixed made-up set: each step of the descent is one pass of Spark over them
that adds up their pulls (see `fit`). No label says that a
candidate is no secret: those without a pattern that a first network, which reads
no context and never saw them, takes for secrets by their shape teach nothing.
Every secret is shown a second time in the context of a candidate that is none,
so that keys are found that no pattern introduces. The output is calibrated on
all candidates held out; the threshold is even odds, or lower where that is
needed to find `RECALL` of the held-out secrets, however rare secrets are.
"""
from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from proofmill.llm.quality import calibrated
from proofmill.llm.tables import written
from proofmill.operators.keyed import numbered

KINDS = ("assign", "access", "hex")
ADDED = "network"
CONTEXT, WIDTH, FILTERS, RECALL = 24, 5, 12, 0.98
FIXED_OF_EACH = 120
PART, PART_LENGTH = 4_096, 1 << 18  # candidates in a file of the training set; characters read together
GRID, FAR = 1 << 10, 64  # steps of a logit that held-out candidates are counted in, up to so far
UNIT = float(1 << 30)  # pulls are added up as whole numbers of 1 / UNIT, so their order does not matter
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: a shorter run fails, a longer one starts where it starts
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
DIGIT = re.compile(r"[0-9]")


# A class for each ASCII character, one for all others, one for the border.
N_CLASSES, BORDER = 130, 129


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, end, KINDS[k]) for start, k, end in sorted(out)]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if DIGIT.search(m[0])]


def beside(spans: list[tuple[int, int, str]], found: list[tuple[int, int]]) -> list[bool]:
    """Whether each stretch of `found` shares a character with one of `spans`."""
    starts, ends = [], []  # the spans' union, in order
    for start, end, _ in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    last = [bisect_left(starts, b) - 1 for _, b in found]
    return [i >= 0 and ends[i] > a for i, (a, _) in zip(last, found)]


@dataclass
class Windows:
    """Character classes of all windows in a row, and for each the first place
    of its left context, candidate and right context, and its end."""

    codes: np.ndarray
    bounds: np.ndarray


def windows(found: list[tuple[str, int, int]]) -> Windows:
    edge = chr(BORDER)
    parts, bounds, at = [], [], 0
    for text, start, end in found:
        left, right = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
        clean = "".join([edge * 2, left, text[start:end], right, edge * 2])
        parts.append(clean)
        bounds.append((at, at + 2 + len(left), at + 2 + len(left) + end - start, at + len(clean)))
        at += len(clean)
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    return Windows(np.where(codes < 128, codes, np.where(codes == BORDER, BORDER, 128)).astype(np.int64), np.array(bounds, np.int64).reshape(-1, 4))


@dataclass
class Network:
    kernel: np.ndarray  # place in the filter, class, filter
    shift: np.ndarray
    weight: np.ndarray  # twice the filters: inside, beside
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0
    recall: float = 0.0  # of held-out secrets, at the threshold
    precision: float = 0.0

    def _answers(self, codes: np.ndarray) -> np.ndarray:
        half, n = WIDTH // 2, len(codes)
        padded = np.concatenate([np.full(half, BORDER), codes, np.full(half, BORDER)])
        return np.maximum(sum(self.kernel[o][padded[o:o + n]] for o in range(WIDTH)) + self.shift, 0)

    def pooled(self, w: Windows) -> np.ndarray:
        """The strongest answers inside each candidate, then beside it."""
        h = self._answers(w.codes)
        edges = w.bounds[:, :3].ravel()
        top = np.maximum.reduceat(h, edges).reshape(len(w.bounds), 3, -1)
        return np.concatenate([top[:, 1], np.maximum(top[:, 0], top[:, 2])], axis=1)

    def logits(self, w: Windows) -> np.ndarray:
        return self.pooled(w) @ self.weight + self.bias if len(w.bounds) else np.zeros(0)

    def probability(self, w: Windows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(w) + self.offset, -40, 40)))


def _strongest(h: np.ndarray, w: Windows) -> np.ndarray:
    """The place of the strongest answer of each filter, inside and beside; the
    first of several."""
    edges = w.bounds[:, :3].ravel()
    top = np.maximum.reduceat(h, edges)
    part = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(h))))
    places = np.empty(top.shape, np.int64)
    at, f = np.nonzero(h == top[part])
    places[part[at[::-1]], f[::-1]] = at[::-1]  # the first place is written last
    top, places = top.reshape(-1, 3, h.shape[1]), places.reshape(-1, 3, h.shape[1])
    return np.concatenate([places[:, 1], np.where(top[:, 2] > top[:, 0], places[:, 2], places[:, 0])], axis=1)


def _sizes() -> list[int]:
    return [WIDTH * N_CLASSES * FILTERS, FILTERS, 2 * FILTERS, 1]


def _network(flat: np.ndarray) -> Network:
    kernel, shift, weight, bias = np.split(flat, np.cumsum(_sizes())[:-1])
    return Network(kernel.reshape(WIDTH, N_CLASSES, FILTERS), shift, weight, float(bias[0]))


def pulls(net: Network, w: Windows, y: np.ndarray) -> dict[int, np.ndarray]:
    """For either label the sum over its candidates of the slope of their loss by
    each parameter, in units of 1 / `UNIT`; the gradient runs through each
    filter's strongest place."""
    padded = np.concatenate([np.full(WIDTH // 2, BORDER), w.codes, np.full(WIDTH // 2, BORDER)])
    filters = np.tile(np.arange(FILTERS), 2)
    h = net._answers(w.codes)
    at = _strongest(h, w)
    top = h[at, filters]
    gap = 1 / (1 + np.exp(-np.clip(top @ net.weight + net.bias, -40, 40))) - y
    inner = np.rint(UNIT * gap[:, None] * net.weight * (top > 0))
    out = {}
    for k in (0, 1):
        own = y == k
        if own.any():
            cell = padded[at[own][None] + np.arange(WIDTH)[:, None, None]] * FILTERS + filters
            kernel = [np.bincount(c.ravel(), inner[own].ravel(), N_CLASSES * FILTERS) for c in cell]
            out[k] = np.concatenate([*kernel, np.bincount(np.tile(filters, own.sum()), inner[own].ravel(), FILTERS),
                                     np.rint(UNIT * top[own] * gap[own][:, None]).sum(0), [np.rint(UNIT * gap[own]).sum()]])
    return out


def descended(pulled: Callable[[list[Network]], dict[tuple[int, int], np.ndarray]], counts: dict[tuple[int, int], int], epochs: int, rate: float) -> list[Network]:
    """Full-batch Adam for several networks at once, either label half of the
    weight. `counts` and what `pulled` gives are by network and label."""
    rng = np.random.default_rng(11)
    start = np.concatenate([rng.normal(0, 0.3, WIDTH * N_CLASSES * FILTERS), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), [0.0]])
    decay = np.repeat([1e-5, 0, 1e-4, 0], _sizes())
    flat = [start.copy() for _ in range(1 + max(i for i, _ in counts))]
    m, v = [np.zeros_like(start) for _ in flat], [np.zeros_like(start) for _ in flat]
    for t in range(1, epochs + 1):
        found = pulled([_network(x) for x in flat])
        for i, x in enumerate(flat):
            g = decay * x
            for k in (0, 1):
                if (i, k) in found:
                    g += found[i, k] * (0.5 / UNIT / max(counts.get((i, k), 0), 1))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-8)
    return [_network(x) for x in flat]


def train(w: Windows, y: np.ndarray, epochs: int = 120, rate: float = 0.05) -> Network:
    """A network from the candidates in hand."""
    counts = {(0, k): int((y == k).sum()) for k in (0, 1)}
    return descended(lambda nets: {(0, k): g for k, g in pulls(nets[0], w, y).items()}, counts, epochs, rate)[0]


def settle(net: Network, w: Windows, y: np.ndarray, odds: float = 1.0) -> Network:
    """Calibration, threshold and what it finds, on held-out candidates; `odds` are
    those of a secret among all candidates over those in the sample. They scale
    the probabilities, not the order, so they move the threshold along."""
    return settled(net, net.logits(w), y, np.ones(len(y)), odds)


def settled(net: Network, z: np.ndarray, y: np.ndarray, n: np.ndarray, odds: float = 1.0) -> Network:
    """The same by logits `z` and labels `y` that `n` held-out candidates have."""
    net.slope, net.offset = calibrated(z, y.astype(float), n)
    net.offset += float(np.log(odds))
    p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.offset, -40, 40)))
    order = np.argsort(p, kind="stable")
    right = order[y[order] > 0]
    upto = np.cumsum(n[right])
    net.threshold = min(float(p[right[np.searchsorted(upto, int((1 - RECALL) * upto[-1]), "right")]]), 0.5)
    hit = p >= net.threshold
    net.recall, net.precision = float(n[hit & (y > 0)].sum() / upto[-1]), float(n[hit & (y > 0)].sum() / max(n[hit].sum(), 1))
    return net


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            found = candidates(text)
            for (a, b), secret in zip(found, beside(base_spans(text), found)):
                rows.append((text[max(0, a - CONTEXT):a], text[a:b], text[b:b + CONTEXT], int(secret)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.int32())],
                                         ["before", "candidate", "after", "secret"])


def fixed_set() -> tuple[list[tuple[str, str, str]], list[int]]:
    """`FIXED_OF_EACH` made-up candidates of either label with their context:
    keys that the base patterns find, and addresses, paths, numbers and names."""
    rng = random.Random(17)
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, digits, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = low + upper + digits
    rows, y = [], []
    for i in range(FIXED_OF_EACH):
        name = ("password", "secret", "token", "api_key")[i // 3 % 4]
        rows.append(((f'set {name} = "', drawn(mixed, rng.randint(20, 40)) + "7", '" for the job'), ("with the key ", "AKIA" + drawn(upper + digits, 15) + "7", " in the file"),
                     ("the value ", drawn("0123456789abcdef", rng.randint(32, 64)) + "7", " was set"))[i % 3])
        y.append(1)
        word = lambda: drawn(low, rng.randint(3, 9))
        rows.append((("see https:", f"//www.{word()}.com/{word()}/{drawn(digits, 4)}/{word()}", " for more"), ("in the folder ", f"/{word()}/{word()}/{word()}-{drawn(digits, 2)}.txt", " there is"),
                     ("call or pay ", drawn(digits, rng.randint(16, 20)), " by Monday"), ("at ", f"20{drawn(digits, 2)}-{drawn(digits, 2)}-{drawn(digits, 2)}-{word()}-{word()}", ", it was"))[i % 4])
        y.append(0)
    return rows, y


SAMPLE = "before string, candidate string, after string, secret int, held boolean, own boolean"
_ROW = ["before", "candidate", "after", "secret", "held", "own"]


def training_rows(docs: DataFrame) -> DataFrame:
    """All different candidates of all documents, whole, with the label the base
    patterns give them, and the fixed set. A third of either source is `held`
    out; three pairs of the fixed set together, so that every kind is."""
    found = docs.select("text").mapInArrow(_labelled, "before string, candidate string, after string, secret int").distinct()
    held = F.pmod(F.xxhash64("candidate", "before", "after"), F.lit(3)) == 0
    found = found.select("before", "candidate", "after", "secret", held.alias("held"), F.lit(True).alias("own"))
    more = [(*row, k, i // 6 % 3 == 0, False) for i, (row, k) in enumerate(zip(*fixed_set()))]
    return found.unionByName(docs.sparkSession.createDataFrame(more, SAMPLE))


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table whose files hold about `PART` rows each."""
    rows = written(rows.select(*_ROW), name)
    return written(rows.repartition(1 + rows.count() // PART, "candidate", "before", "after"), f"{name}-dealt")


def _read(batches: Iterator[pa.RecordBatch], context: bool) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    """Rows with their windows, some `PART_LENGTH` characters at a time."""
    for batch in batches:
        first, size = 0, 0
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("before", "candidate", "after")]))
        for i, row in enumerate(rows):
            size += len(row[1]) + 2 * CONTEXT + 4
            if size >= PART_LENGTH or i == len(rows) - 1:
                texts = [(a + b + c, len(a), len(a) + len(b)) if context else (b, 0, len(b)) for a, b, c in rows[first:i + 1]]
                yield batch.slice(first, i + 1 - first), windows(texts)
                first, size = i + 1, 0


def encoded(rows: Iterator[Row], context: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of many rows in turn, with their labels and networks."""
    held, size = [], 0
    for r in chain(rows, [None]):
        if held and (r is None or size >= PART_LENGTH):
            w = windows([(h.before + h.candidate + h.after, len(h.before), len(h.before) + len(h.candidate)) if context else (h.candidate, 0, len(h.candidate)) for h in held])
            yield w.codes.astype(np.uint8), w.bounds, np.array([h.secret for h in held]), np.array([h.net for h in held])
            held, size = [], 0
        if r is not None:
            held.append(r)
            size += len(r.candidate) + 2 * CONTEXT + 4


def summed(parts: Iterator[tuple], nets: list[Network]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """`pulls` of a task's candidates, each on the network of its number, added up."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for codes, bounds, y, own in parts:
        w = Windows(codes.astype(np.int64), bounds)
        for i in np.unique(own).tolist():
            mine = np.flatnonzero(own == i)
            for k, g in pulls(nets[i], w if len(mine) == len(own) else _taken(w, mine), y[mine]).items():
                sums[i, k] = sums[i, k] + g if (i, k) in sums else g
    yield from sums.items()


def pulled(rows: RDD, nets: list[Network]) -> dict[tuple[int, int], np.ndarray]:
    """`pulls` of all rows, added up: a task sends one row for each network and label."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for key, g in rows.mapPartitions(lambda parts: summed(parts, nets)).collect():
        out[key] = out.get(key, 0) + g
    return out


def _taken(w: Windows, rows: np.ndarray) -> Windows:
    """The windows of some rows."""
    first, last = w.bounds[rows, 0], w.bounds[rows, 3]
    codes = np.concatenate([w.codes[a:b] for a, b in zip(first, last)])
    shift = first - np.concatenate([[0], np.cumsum(last - first)[:-1]])
    return Windows(codes, w.bounds[rows] - shift[:, None])


def _trained(rows: DataFrame, context: bool, epochs: int, rate: float = 0.05) -> list[Network]:
    counts = {(r.net, r.secret): r.n for r in rows.groupBy("net", "secret").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers a network
    held = rows.rdd.mapPartitions(lambda part: encoded(part, context)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return descended(lambda nets: pulled(held, nets), counts, epochs, rate)
    finally:
        held.unpersist()


def judged(rows: DataFrame, nets: list[Network], context: bool) -> DataFrame:
    """Each row with the logit its network gives it, the number `net` again, and
    whether that reaches the network's threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _read(batches, context):
            own = batch.column("net").to_numpy()
            z, hit = np.zeros(len(own)), np.zeros(len(own), bool)
            for i in np.unique(own):
                mine = np.flatnonzero(own == i)
                part = _taken(w, mine)
                z[mine], hit[mine] = nets[i].logits(part), nets[i].probability(part) >= nets[i].threshold
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z), pa.array(hit)], [*batch.schema.names, "logit", "hit"])

    return rows.mapInArrow(run, f"{SAMPLE}, net int, logit double, hit boolean")


def _settled(rows: DataFrame, nets: list[Network], context: bool) -> list[Network]:
    """Networks settled on all rows, counted by steps of their logit: at most
    2 * `FAR` * `GRID` numbers for either label reach the driver."""
    step = F.floor(F.greatest(F.least("logit", F.lit(float(FAR))), F.lit(-float(FAR))) * GRID)
    found = judged(rows, nets, context).groupBy("net", "secret", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("net", "secret", "step").toArrow()
    net, secret, at, n = [found.column(c).to_numpy() for c in ("net", "secret", "step", "n")]
    return [settled(one, at[net == i] / GRID, secret[net == i], n[net == i].astype(float)) for i, one in enumerate(nets)]


def fit(docs: DataFrame) -> Network:
    """A network from all labelled candidates of all documents and the fixed set.
    Those held out calibrate; tables without secrets, or with nothing else,
    have the fixed set's. The driver holds the networks and their gradients only.
    """
    rows = _dealt(training_rows(docs), "candidates")
    # each part is judged by the network of the other
    firsts = _trained(rows.withColumn("net", F.when(F.col("held"), 0).otherwise(1)), False, epochs=40)
    apart = rows.withColumn("net", F.when(F.col("held"), 1).otherwise(0))
    firsts = _settled(apart, firsts, False)
    unknown = F.col("own") & (F.col("secret") == 0) & F.col("hit")
    known = written(judged(apart, firsts, False).filter(~unknown).select(*_ROW), "known")
    rows = _dealt(known.unionByName(transplanted(known)), "shown").withColumn("net", F.lit(0))
    return _settled(rows.filter("held"), _trained(rows.filter("not held"), True, epochs=120), True)[0]


def transplanted(rows: DataFrame) -> DataFrame:
    """Each secret between the words around a candidate that is none; held-out
    ones stay among themselves."""
    order = [F.xxhash64("candidate", "before", "after"), *map(F.col, _ROW)]
    sizes = {(r.secret, r.held): r.n for r in rows.groupBy("secret", "held").agg(F.count(F.lit(1)).alias("n")).collect()}  # four numbers
    def counted(secret: int) -> DataFrame:
        own = numbered(rows.filter(F.col("secret") == secret), [F.col("held"), *order], "_n")
        return own.withColumn("_n", F.col("_n") - 1 - F.when(F.col("held"), sizes.get((secret, False), 0)).otherwise(0))
    many = F.when(F.col("held"), sizes.get((0, True), 0)).otherwise(sizes.get((0, False), 0))
    secrets = counted(1).filter(many > 0).withColumn("_n", F.col("_n") % many)
    return secrets.drop("before", "after").join(counted(0).select("held", "_n", "before", "after"), ["held", "_n"]).select(*_ROW)


def scan(texts: list[str], net: Network | None) -> list[tuple[list, list]]:
    """Base spans and all spans of each text; the network adds candidates that
    touch no base span and reach its threshold."""
    base = [base_spans(t) for t in texts]
    every = [list(s) for s in base]
    if net is not None:
        found = []
        for i, t in enumerate(texts):
            places = candidates(t)
            found += [(i, t, a, b) for (a, b), known in zip(places, beside(base[i], places)) if not known]
        for first in range(0, len(found), 2048):
            part = found[first:first + 2048]
            for (i, _, a, b), p in zip(part, net.probability(windows([x[1:] for x in part]))):
                if p >= net.threshold:
                    every[i].append((a, b, ADDED))
        every = [sorted(s, key=lambda x: (x[0], (*KINDS, ADDED).index(x[2]))) for s in every]
    return list(zip(base, every))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def findings(docs: DataFrame, net: Network | None, id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: counts of the base kinds, the digest of the
    base spans, and all spans as text. Ends are exclusive, in code points. Null
    and empty texts have no spans; repeated rows are scanned alike.
    """
    kind = docs.schema[id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)
    columns = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out = scan([t or "" for t in rows.column(1).to_pylist()], sent.value)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in out], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in out]
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(digests, pa.string()), pa.array([shown(every) for _, every in out], pa.string())], [id, *columns])

    return docs.select(F.col(id), F.col("text")).mapInArrow(run, f"`{id}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
