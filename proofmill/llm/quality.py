"""Quality rules: counts over words and lines, and a classifier on hashed n-grams.

A logistic regression reads two averages: hashed word one- and two-grams over
the words of a text, and hashed three-byte grams over its bytes. It is trained
here on labelled rows (a bounded sample, see `fit`), calibrated on rows held
out of the training, and compared with one fixed threshold.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.words import chunks, mixed, spans_hash, words

SLOTS = 1 << 13
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 50, 50, 0.5
TRAIN_ROWS = 1600
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SAME = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    """Weights of word slots and byte slots; slope and offset of the calibration."""

    word: np.ndarray
    byte: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))


def _slots(data: np.ndarray, offsets: np.ndarray, found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slot and text of each word gram, slot and text of each byte gram."""
    at, pair = found.grams(2)
    if len(at):
        pair = np.where(found.hash[at] == found.hash[at + 1], _SAME, pair)  # a word said twice, whichever it is
    word = (np.concatenate([found.hash, pair]) >> np.uint64(20)) & np.uint64(SLOTS - 1)
    word_text = np.concatenate([found.text, found.text[at]])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    d = data.astype(np.uint32)
    gram = (d[:-2] | d[1:-1] << 8 | d[2:] << 16) if len(d) > 2 else np.zeros(0, np.uint32)
    inside = text[:-2] == text[2:] if len(d) > 2 else np.zeros(0, bool)
    byte = (gram * np.uint32(2654435761)) >> np.uint32(32 - 13)
    return word.astype(np.int32), word_text, byte[inside].astype(np.int32), text[:len(inside)][inside]


def _means(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, values, n) / np.maximum(np.bincount(text, minlength=n), 1)


def score(model: Model, data: np.ndarray, offsets: np.ndarray, found) -> np.ndarray:
    word, word_text, byte, byte_text = _slots(data, offsets, found)
    n = len(offsets) - 1
    return model.probability(_means(model.word[word], word_text, n) + _means(model.byte[byte], byte_text, n) + model.bias)


def _repeats(found, n: int) -> np.ndarray:
    """Words inside three-word windows that a text holds twice or more."""
    at, h = found.grams(3)
    out = np.zeros(len(found.hash), bool)
    if len(at):
        h = mixed(h + found.text[at].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(3):
            out[at[twice] + i] = True
    return np.bincount(found.text, out, n).astype(np.int64)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, found, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, offsets[text + 1], np.append(start[1:], 1) - 1)
    wordy = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end, text = start[wordy], end[wordy], text[wordy]
    h = mixed(spans_hash(data, start, end) + text.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    order = np.argsort(h, kind="stable")
    later = order[1:][h[order[1:]] == h[order[:-1]]]
    return np.bincount(text[later], minlength=n)


def _characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return firsts[end] - firsts[start]


def measures(data: np.ndarray, offsets: np.ndarray, model: Model | None) -> dict[str, np.ndarray]:
    """The counts, the base rules' verdict, the probability and the verdict of each text."""
    n, found = len(offsets) - 1, words(data, offsets)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    out = {"n_words": found.counts.astype(np.int64),
           "word_chars": np.bincount(found.text, _characters(data, found.start, found.end), n).astype(np.int64),
           "n_symbols": (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64),
           "n_dup_lines": _repeated_lines(data, offsets, found, n), "n_repeat_words": _repeats(found, n)}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["probability"] = score(model, data, offsets, found) if model is not None else np.ones(n)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= KEEP_AT)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots with a value (word slots first) of each labelled text."""
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text")):
            word, word_text, byte, byte_text = _slots(data, offsets, words(data, offsets))
            slots, shares = [], []
            for i in range(last - first):
                w = np.bincount(word[word_text == i], minlength=SLOTS)
                b = np.bincount(byte[byte_text == i], minlength=SLOTS)
                both = np.concatenate([w / max(w.sum(), 1), b / max(b.sum(), 1)])
                at = np.flatnonzero(both)
                slots.append(at.astype(np.int32))
                shares.append(both[at].astype(np.float32))
            rows = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [rows.column("good"), rows.column("part"), pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                ["good", "part", "slots", "shares"])


def _descend(slots, shares, rows, y, steps: int = 250, rate: float = 0.5, pull: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights by Adam over all rows at once."""
    n = len(y)
    w, b = np.zeros(2 * SLOTS), 0.0
    m, v, t = np.zeros(2 * SLOTS + 1), np.zeros(2 * SLOTS + 1), 0
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[slots] * shares, n) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.append(np.bincount(slots, gap[rows] * shares, 2 * SLOTS) + pull * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def calibrated(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset by Newton's method, on smoothed targets (Platt); each
    pair of `z` and `y` counts `n` times, or once."""
    n = np.ones(len(z)) if n is None else n
    good, bad = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    def loss(a: float, c: float) -> float:
        s = a * z + c
        return float((n * (np.logaddexp(0, s) - target * s)).sum() + 5e-4 * (a - 1) ** 2)

    a, c, now = 1.0, 0.0, loss(1.0, 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(n * (p - target) * z).sum() + 1e-3 * (a - 1), (n * (p - target)).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        while (then := loss(a - step[0], c - step[1])) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if now - then < 1e-10:
            break
        a, c, now = a - step[0], c - step[1], then
    return float(max(a, 1e-3)), float(c)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from at most `train_rows` labelled documents, half of either
    label, the first ones in the order of a hash of their ids; a quarter of
    them is held out for the calibration. None without both labels.

    The bound is on the sample only: a row holds at most 2 * SLOTS numbers, so
    what reaches the driver is bounded too. Labels that are neither 0 nor 1
    and ids labelled both ways are left out.
    """
    sure = (labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
            .agg(F.min("quality").alias("good"), F.max("quality").alias("_other")).filter("good = _other"))
    picked = [sure.filter(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select("doc_id", F.col("good").cast("int").alias("good"), F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).cast("int").alias("part"))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("good", "part", "text")
    rows = sample.mapInArrow(_features, "good int, part int, slots array<int>, shares array<float>").toArrow()
    y, part = rows["good"].to_numpy(), rows["part"].to_numpy()
    if len(set(y[part > 0])) < 2:
        return None
    counts = np.array([len(x) for x in rows["slots"]], np.int64)
    owner = np.repeat(np.arange(len(y)), counts)
    slots = rows["slots"].combine_chunks().flatten().to_numpy()
    shares = rows["shares"].combine_chunks().flatten().to_numpy().astype(float)
    used = (part > 0)[owner]
    place = np.cumsum(part > 0) - 1
    w, b = _descend(slots[used], shares[used], place[owner[used]], y[part > 0].astype(float))
    model = Model(w[:SLOTS], w[SLOTS:], b)
    held = part == 0
    if held.sum() and len(set(y[held])) == 2:
        z = np.bincount(owner, w[slots] * shares, len(y)) + b
        model.slope, model.offset = calibrated(z[held], y[held].astype(float))
    return model


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
           "base_failed": "boolean", "probability": "double", "kept": "boolean"}


def judged(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of `docs`, and what `measures` finds in its
    text. A null text has no words, so the base rules fail it. Without a model
    the base rules alone decide. Repeated rows are judged alike, each on its own.
    """
    others = [c for c in keep if c != "text"]
    taken = [F.struct(*[F.col(c) for c in others]).alias("_row"), F.col("text")]
    fields = docs.select(*[F.col(c) for c in others]).schema.simpleString()
    shown = ", text string" if "text" in keep else ""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                rows = batch.slice(first, last - first)
                found = measures(data, offsets, sent.value)
                yield pa.RecordBatch.from_arrays([*rows.columns[:2 if shown else 1], *[pa.array(found[c]) for c in COLUMNS]],
                                                 ["_row", *(["text"] if shown else []), *COLUMNS])

    out = docs.select(*taken).mapInArrow(run, f"_row {fields}{shown}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in keep], *COLUMNS)
