"""Importance resampling towards a target: hashed word n-grams, exact totals.

Every run of 1 to 3 words falls into the bucket of its CRC-32. Frequent words
and frequent pairs of them make the head, counted over all texts and sent to
every task: of a word its CRC and that of the word behind a space, of a pair
the CRC of both. The CRC of a longer run follows from that of its beginning,
moved on by the length of the added word, and the word's own: a look-up and an
exclusive or over whole arrays. Words outside the head take the CRC of their
bytes. Both give the same number, so the head decides on speed alone, and the
totals of the buckets are exact.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.tables import written
from proofmill.operators.keyed import numbered

BUCKETS, GRAM = 10_000, 3
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 15, 1 << 16, 63
COUNTED = 1 << 18  # entries a task counts at once
LEAST_WORDS, SHARE, SEED = 20, 5, 42  # documents that may be drawn, how many of a hundred, the draw's key
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, A to Z as small letters."""
    return _WORD.findall((text or "").encode().lower())


@dataclass
class Head:
    place: dict[bytes, int]
    crc: np.ndarray       # of each word
    spaced: np.ndarray    # of a space and the word
    size: np.ndarray      # bytes of a space and the word
    pair: np.ndarray      # sorted keys of the frequent pairs
    pair_crc: np.ndarray


def head_of(words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> Head:
    place = {w: i for i, w in enumerate(words)}
    known = [(place[a] << 32 | place[b], crc32(a + b" " + b)) for a, b in pairs if a in place and b in place]
    known.sort()
    return Head(place, np.array([crc32(w) for w in words], np.uint32), np.array([crc32(b" " + w) for w in words], np.uint32),
                np.array([len(w) + 1 for w in words], np.int64), np.array([k for k, _ in known], np.int64), np.array([c for _, c in known], np.uint32))


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """What `size` zero bytes make of each byte of a CRC: [size, place, byte]."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    out = np.empty((HEAD_BYTES + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for i in range(1, len(out)):
        out[i] = one[out[i - 1] & 255] ^ out[i - 1] >> 8
    return out


def _longer(state: np.ndarray, at: np.ndarray, ids: np.ndarray, names: list[bytes], codes: np.ndarray, head: Head) -> np.ndarray:
    """CRCs moved on by a space and the words at `at`."""
    out = np.empty(len(at), np.uint32)
    own = ids[at]
    known = own >= 0
    moves, s, size = _moves(), state[known], head.size[own[known]]
    moved = moves[size, 0, s & 255] ^ moves[size, 1, s >> 8 & 255] ^ moves[size, 2, s >> 16 & 255] ^ moves[size, 3, s >> 24]
    out[known] = moved ^ head.spaced[own[known]]
    rest = np.flatnonzero(~known)
    out[rest] = [crc32(b" " + names[i], c) for i, c in zip(codes[at[rest]].tolist(), state[rest].tolist())]
    return out


def _coded(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """The different words of some texts, and which of them each word is."""
    found = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def buckets(texts: list[list[bytes]], head: Head) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of some texts, and the text of each."""
    sizes = np.array([len(t) for t in texts])
    names, codes = _coded(texts)
    n, get = len(codes), head.place.get
    own = np.repeat(np.arange(len(texts)), sizes)
    places = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
    known = places >= 0
    crc = np.empty(len(names), np.uint32)
    crc[known] = head.crc[places[known]]
    crc[~known] = [crc32(names[i]) for i in np.flatnonzero(~known).tolist()]
    ids, state = places[codes], crc[codes]
    parts, owners = [state % BUCKETS], [own]
    for more in range(1, min(GRAM, n)):
        inside = np.flatnonzero(own[:-more] == own[more:])
        before = state[inside]  # state[i]: the run of `more` words from i
        at = inside + more
        if more == 1 and len(head.pair):
            key = ids[inside] << 32 | ids[at]
            where = np.minimum(np.searchsorted(head.pair, key), len(head.pair) - 1)
            seen = (head.pair[where] == key) & (ids[inside] >= 0) & (ids[at] >= 0)
            now = np.empty(len(inside), np.uint32)
            now[seen] = head.pair_crc[where[seen]]
            now[~seen] = _longer(before[~seen], at[~seen], ids, names, codes, head)
        else:
            now = _longer(before, at, ids, names, codes, head)
        state = np.zeros(n, np.uint32)
        state[inside] = now
        parts.append(now % BUCKETS)
        owners.append(own[inside])
    return np.concatenate(parts).astype(np.int64), np.concatenate(owners)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of some rows at a time, about half a million bytes."""
    first, held, weight = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        held.append(words_of(text))
        weight += len(text)
        if weight >= 1 << 19:
            yield first, held
            first, held, weight = i + 1, [], 0
    if held:
        yield first, held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words and pairs of a task's texts. What occurs once in
    a chunk is not counted there, and a full table drops its rarer half: what
    is frequent in the task stays, and no result depends on it."""
    single: Counter = Counter()
    double: Counter = Counter()
    for batch in batches:
        for _, texts in _texts(batch, 0):
            names, ids = _coded(texts)
            own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            times = np.bincount(ids, minlength=len(names))
            some = np.flatnonzero(times > 1)
            single.update(dict(zip([names[i] for i in some.tolist()], times[some].tolist())))
            pair = np.sort((ids[:-1] << 32 | ids[1:])[own[:-1] == own[1:]])
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
            times = np.diff(np.append(first, len(pair)))
            some = pair[first[times > 1]].tolist()
            double.update(dict(zip([(names[k >> 32], names[k & 0xFFFFFFFF]) for k in some], times[times > 1].tolist())))
            for table in (single, double):
                if len(table) > COUNTED:
                    few = dict(table.most_common(COUNTED // 2))
                    table.clear()
                    table.update(few)
    rows = [(w, None, c) for w, c in single.most_common(HEAD_WORDS) if len(w) <= HEAD_BYTES]
    rows += [(a, b, c) for (a, b), c in double.most_common(HEAD_PAIRS) if max(len(a), len(b)) <= HEAD_BYTES]
    a, b, c = zip(*rows) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], ["a", "b", "n"])


def head(docs: DataFrame) -> Head:
    """At most `HEAD_WORDS` words and `HEAD_PAIRS` pairs, whatever the size of
    the table: counts fall into eight steps an octave, and as many of the upper
    steps as fit come to the driver."""
    counts = docs.select("text").mapInArrow(_counted, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "counts")
    sizes = counts.groupBy(F.col("b").isNull().alias("single"), "step").count().collect()

    def top(single: bool, most: int) -> list:
        least, total = 1 << 30, 0
        for r in sorted((r for r in sizes if r["single"] == single), key=lambda r: -r["step"]):
            total += r["count"]
            if total > most:
                break
            least = r["step"]
        rows = counts.filter((F.col("b").isNull() == F.lit(single)) & (F.col("step") >= least)).collect()
        return sorted(rows, key=lambda r: (-r.n, bytes(r.a), bytes(r.b or b"")))

    return head_of([bytes(r.a) for r in top(True, HEAD_WORDS)], [(bytes(r.a), bytes(r.b)) for r in top(False, HEAD_PAIRS)])


def _summed(known: Callable[[], Head]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in _texts(batch, 0):
                total += np.bincount(buckets(texts, known())[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    return run


def totals(docs: DataFrame, head: Head) -> np.ndarray:
    """Features of all texts in each of the `BUCKETS` buckets."""
    sent = docs.sparkSession.sparkContext.broadcast(head)
    rows = docs.select("text").mapInArrow(_summed(lambda: sent.value), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, head: Head, gain: np.ndarray, id: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight) for each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast((head, gain))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = sent.value
        for batch in batches:
            for first, texts in _texts(batch, 1):
                bucket, own = buckets(texts, known)
                n = len(texts)
                weight = np.zeros(n, np.int64)
                np.add.at(weight, own, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.bincount(own, minlength=n)), pa.array(weight)],
                                                 [id, "n_words", "n_features", "weight"])

    return docs.select(F.col(id), F.col("text")).mapInArrow(run, f"`{id}` {kind}, n_words long, n_features long, weight long")


def drawn(docs: DataFrame, target: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of `docs`: its weight
    towards the texts of `target`, the weight plus a Gumbel number drawn from
    its id, and its place among the drawn, null for all others.

    Null and empty texts have no features and weigh nothing; documents of
    fewer than `LEAST_WORDS` words are never drawn. Rows that share an id have
    one Gumbel number each the same; rows that tie in score and id are drawn
    in either order, which no column shows but the rank. A null id draws as
    the empty string and comes behind the others that tie. Empty tables of
    either side are well defined: no features, gains by the other side alone.
    Columns other than id and text are not read.
    """
    known = head(docs)
    gain = gains(totals(docs, known), totals(target, known))
    rows = weighted(docs, known, gain, id)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    fit = F.col("n_words") >= LEAST_WORDS
    rows = written(rows.select(id, "n_words", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), fit.alias("fit")), "scores")
    most = rows.filter("fit").count() * SHARE // 100
    placed = numbered(rows, [F.col("fit").desc(), F.col("score").desc(), F.col(id).asc_nulls_last(), F.col("n_features"), F.col("weight")], "place")
    return placed.select(id, "n_features", "weight", "score", F.when(F.col("fit") & (F.col("place") <= most), F.col("place")).alias("rank"))
