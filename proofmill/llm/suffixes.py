"""Suffix-array dedup: bytes that long repeated strings cover.

A string of `LENGTH` bytes holds `LENGTH - GRAM + 1` grams of `GRAM` bytes.
The gram of the least hash in it (the rightmost of several) is its anchor, and
equal strings have equal anchors at the same place. So a string can only
repeat when its anchor's gram does: grams are counted first, and all that
hangs on a gram that occurs once is done with. What hangs on the others, a
segment of neighbouring strings with one anchor, goes to the gram's bucket,
equal segments as one with their number.

A bucket's segments form one text with a suffix array, ordered by rank
doubling. For each suffix the previous and the next entry in suffix order that
start earlier in the text give its longest previous factor; the entries that
start later give the longest next factor. Strings whose factor reaches
`LENGTH` repeat. Buckets are split into parts of at most `PART` segments; the
first string of each class then meets those of the other parts by its hash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.tables import written
from proofmill.llm.words import _BASE, _UNDO, BYTE_CODES, _powers, chunks, mixed

LENGTH, GRAM, PART, PIECE, BATCH_BYTES = 400, 64, 1536, 1 << 20, 1 << 19
_PLACE = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=1)
def _rows() -> tuple[np.ndarray, np.ndarray]:
    """Powers for a whole piece."""
    return _powers(_BASE, PIECE + LENGTH), _powers(_UNDO, PIECE + LENGTH + 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64((1 << 64) - 1))
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece of text: gram hash, segment hash, first and last string of
    each run of strings with one anchor."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sums = np.zeros(n + 1, np.uint64)
    forth, undo = _rows()
    np.cumsum(BYTE_CODES[data] * forth[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * undo[:n - gram + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    anchor = (_PLACE - (_least((grams & ~_PLACE) | (_PLACE - places), length - gram + 1) & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], len(anchor)) - 1
    whole = mixed((sums[last + length] - sums[first]) * undo[first] + (last - first).astype(np.uint64))
    return grams[anchor[first]].view(np.int64), whole.view(np.int64), first, last


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text"), PIECE):
            rows, found = [], []
            for i in np.flatnonzero(np.diff(offsets) >= LENGTH):
                text = data[offsets[i]:offsets[i + 1]]
                for at in range(0, len(text) - LENGTH + 1, PIECE):  # strings that begin in this piece
                    gram, whole, a, b = segments(text[at:at + PIECE + LENGTH - 1])
                    rows.append(np.full(len(gram), first + i))
                    found.append((gram, whole, a + at, b + at))
            if found:
                taken = batch.select(["doc_id", "version"]).take(pa.array(np.concatenate(rows)))
                columns = [pa.array(np.concatenate(x)) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays([taken.column("doc_id"), taken.column("version"), *columns], ["doc_id", "version", "gram", "segment", "first", "last"])


def ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 3, 6, 12, ... symbols, short of `length`."""
    n, symbol = len(text), np.unique(text, return_inverse=True)[1].astype(np.uint64)
    size, width = np.uint64(max(int(symbol.max()) + 2, 2).bit_length()), 3
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key <<= size
        key[:max(n - i, 0)] += symbol[i:] + np.uint64(1)
    rank = _dense(key, int(size) * width)
    out = [(1, symbol.astype(np.int64)), (width, rank)]
    while 2 * width <= length:
        rank = _joined(rank, width)
        width *= 2
        out.append((width, rank))
    return [x for x in out if x[0] <= length]


def _joined(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks by a suffix's own rank and that of the suffix `shift` further on."""
    bits = len(rank).bit_length()
    key = rank.astype(np.uint64) << np.uint64(bits)
    key[:max(len(rank) - shift, 0)] += rank[shift:].astype(np.uint64) + np.uint64(1)
    return _dense(key, 2 * bits)


def _dense(key: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of keys of so many bits; a key and its place are sorted as one number where they fit."""
    place = np.uint64(len(key).bit_length())
    if bits + int(place) <= 64:
        both = np.sort(key << place | np.arange(len(key), dtype=np.uint64))
        order, key = (both & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64), both >> place
    else:
        order = np.argsort(key)
        key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.append(0, np.cumsum(key[1:] != key[:-1]))
    return out


def _common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to `length` and a bit."""
    n, out = len(levels[0][1]), np.zeros(len(a), np.int64)
    for width, rank in [levels[-1], *[x for x in reversed(levels) for _ in range(2)]]:
        x, y = a + out, b + out
        fit = (x + width <= n) & (y + width <= n)
        same = np.zeros(len(a), bool)
        same[fit] = rank[x[fit]] == rank[y[fit]]
        out[same] += width
    return out


def _nearest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the place of the nearest smaller value before it and after it; -1 and n where there is none."""
    n = len(values)
    padded = np.concatenate([values, [-1]])  # place -1 and place n
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    for links in (before, after):
        todo = np.arange(n)
        while len(todo := todo[padded[links[todo]] > values[todo]]):
            links[todo] = links[links[todo]]
    return before, after


def factors(text: np.ndarray, length: int = LENGTH, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each suffix, exact up to
    `length`; separators are symbols that occur once. With `least` = `length`
    shorter factors are left at 0, which saves measuring them."""
    n = len(text)
    levels = ranks(text, length)
    width, rank = levels[-1]
    whole = _joined(rank, length - width) if width < length else rank
    order = np.argsort(whole, kind="stable")
    inside = np.arange(n) <= n - length
    out = []
    for places in (order, n - 1 - order):
        best = np.zeros(n, np.int64)
        for near in _nearest(places):
            has = (near >= 0) & (near < n)
            own, other = order[has], order[near[has]]
            if least >= length:
                best[own] = np.maximum(best[own], length * ((whole[own] == whole[other]) & inside[own] & inside[other]))
            else:
                best[own] = np.maximum(best[own], _common(levels, own, other, length))
        out.append(best)
    return out[0], out[1]


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and last of each run of true values, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    edge[1::2] -= 1
    return edge


def judged_segments(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment which of its strings occur in an earlier and which in a
    later segment of the list."""
    symbols, starts = [], []
    at = 0
    for i, t in enumerate(texts):
        symbols += [np.frombuffer(t, np.uint8).astype(np.int64), np.array([256 + i])]
        starts.append(at)
        at += len(t) + 1
    previous, following = factors(np.concatenate(symbols), least=LENGTH)
    out = []
    for s, t in zip(starts, texts):
        strings = slice(s, s + len(t) - LENGTH + 1)
        out.append((previous[strings] >= LENGTH, following[strings] >= LENGTH))
    return out


def _string_hashes(text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    out = []
    for base in (_BASE, 0xD6E8FEB86659FD93):
        powers = _powers(base, LENGTH)
        codes = BYTE_CODES[data]
        out.append(mixed(np.array([(codes[i:i + LENGTH] * powers).sum(dtype=np.uint64) for i in at], np.uint64)).view(np.int64))
    return out[0], out[1]


_SEGMENT = "gram long, segment long, earlier array<int>, either array<int>, lead array<int>, lead_a array<long>, lead_b array<long>"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges buckets as they come, sorted, many at a time."""
    def judge(rows: list[dict]) -> pa.RecordBatch:
        # parts of one bucket may meet here: text order is then that of the places
        rows.sort(key=lambda r: (r["gram"], r["doc_id"] is None, r["doc_id"] or 0, r["version"], r["first"]))
        found = judged_segments([r["bytes"] for r in rows])
        out = []
        for r, (earlier, later) in zip(rows, found):
            lead = np.flatnonzero(~earlier) if r["parts"] > 1 else np.zeros(0, np.int64)
            a, b = _string_hashes(r["bytes"], lead)
            out.append({"gram": r["gram"], "segment": r["segment"], "earlier": _runs(earlier), "either": _runs(earlier | later), "lead": lead, "lead_a": a, "lead_b": b})
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.int64())] * 2]
        names = ["gram", "segment", "earlier", "either", "lead", "lead_a", "lead_b"]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in zip(names, kinds)], names)

    held, weight = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            if weight > BATCH_BYTES and (r["gram"], r["part"]) != (held[-1]["gram"], held[-1]["part"]):
                yield judge(held)
                held, weight = [], 0
            held.append(r)
            weight += len(r["bytes"])
    if held:
        yield judge(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            text = (row.column("text")[0].as_py() or "").encode()
            wanted = row.column("wanted")[0].as_py()
            own = [text[w["first"]:w["last"] + LENGTH] for w in wanted]
            table = pa.Table.from_pylist([{k: w[k] for k in ("gram", "segment", "part", "parts", "first")} for w in wanted],
                                         pa.schema([(k, pa.int64()) for k in ("gram", "segment", "part", "parts", "first")]))
            n = len(wanted)
            same = [pa.array([row.column(c)[0].as_py()] * n, batch.schema.field(c).type) for c in ("doc_id", "version")]
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in table.columns], *same, pa.array(own, pa.binary())],
                                             [*table.column_names, "doc_id", "version", "bytes"])


def repeats(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """(doc_id, version, starts, ends): for each text with repeated strings the
    bytes they cover, as spans that may overlap.

    With `keep_first` a string's first place, by document id and position,
    stays. Repeated rows of an id with one text share their spans; without
    `keep_first` each is the other's copy.
    """
    told = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(told.mapInArrow(_anchored, f"doc_id {kind}, version long, gram long, segment long, first long, last long"), "anchors")
    # as a table of its own: a join that follows its grouping could not split a hot gram
    often = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "grams")
    live = written(rows.join(often, "gram"), "live")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "version", "first", "last")
    distinct = written(live.groupBy("gram", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")), "segments")
    several = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("segments")).filter("segments > 1")
    parts = F.ceil(F.col("segments") / PART).cast("long")
    wanted = distinct.join(several, "gram").select(
        "gram", "segment", parts.alias("parts"), F.pmod(F.xxhash64("segment"), parts).alias("part"), "place.doc_id", "place.version", "place.first", "place.last")
    by_text = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("gram", "segment", "part", "parts", "first", "last")).alias("wanted"))
    by_text = by_text.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    once = told.join(by_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))).select("doc_id", "version", "text", "wanted")
    cut = once.mapInArrow(_cut, f"gram long, segment long, part long, parts long, first long, doc_id {kind}, version long, bytes binary").dropDuplicates(["gram", "segment"])
    dealt = cut.repartition("gram", "part").sortWithinPartitions("gram", "part")
    judged = written(dealt.mapInArrow(_buckets, _SEGMENT), "judged")
    # the first strings of each part meet those of the others
    leads = judged.filter(F.size("lead") > 0).select("gram", "segment", F.explode(F.arrays_zip("lead", "lead_a", "lead_b")).alias("x")).select(
        "gram", "segment", "x.lead", "x.lead_a", "x.lead_b")
    leads = leads.join(distinct.select("gram", "segment", F.struct("place.*").alias("place")), ["gram", "segment"])
    met = leads.groupBy("lead_a", "lead_b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "lead", "gram", "segment")).alias("front")).filter("n > 1")
    more = leads.join(met, ["lead_a", "lead_b"])
    if keep_first:
        more = more.filter((F.col("front.gram") != F.col("gram")) | (F.col("front.segment") != F.col("segment")) | (F.col("front.lead") != F.col("lead")))
    more = more.groupBy("gram", "segment").agg(F.sort_array(F.collect_set("lead")).alias("singles"))
    found = judged.select("gram", "segment", F.col("earlier" if keep_first else "either").alias("runs")).join(more, ["gram", "segment"], "left")
    none = F.array().cast("array<int>")
    # one table, one join: two in a row could not split a segment that stands in most documents
    known = written(distinct.select("gram", "segment", "n", F.col("place").alias("_front")).join(found, ["gram", "segment"], "left"), "known")
    own = live.join(known, ["gram", "segment"])
    copied = F.col("n") > 1
    if keep_first:
        copied &= ~place.eqNullSafe(F.col("_front"))
    runs, singles = F.coalesce("runs", none), F.coalesce("singles", none)
    begin = F.filter(runs, lambda x, i: i % 2 == 0)
    end = F.filter(runs, lambda x, i: i % 2 == 1)
    starts = F.when(copied, F.array(F.col("first"))).otherwise(F.transform(F.concat(begin, singles), lambda x: F.col("first") + x))
    ends = F.when(copied, F.array(F.col("last") + LENGTH)).otherwise(F.transform(F.concat(end, singles), lambda x: F.col("first") + x + LENGTH))
    spans = own.select("doc_id", "version", starts.alias("starts"), ends.alias("ends")).filter(F.size("starts") > 0).distinct()
    return spans.groupBy("doc_id", "version").agg(F.flatten(F.collect_list(F.struct("starts", "ends")["starts"])).alias("starts"), F.flatten(F.collect_list(F.struct("starts", "ends")["ends"])).alias("ends"))


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal spans; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each row of `docs`:
    its UTF-8 bytes without those that repeated strings cover. A null text is
    empty; texts shorter than `LENGTH` bytes lose nothing."""
    return _digested(docs, keep_first, False)


def kept_digests(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """As `kept`, with the SHA-256 of the remaining bytes in their place."""
    return _digested(docs, keep_first, True)


def _digested(docs: DataFrame, keep_first: bool, digest: bool) -> DataFrame:
    spans = repeats(docs, keep_first).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    told = docs.select("doc_id", "text")
    joined = told.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left").select("doc_id", "text", "starts", "ends")
    kind, name = docs.schema["doc_id"].dataType.simpleString(), "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sizes, removed, counts, rest = [], [], [], []
                for text, starts, ends in zip(*[rows.column(c).to_pylist() for c in (1, 2, 3)]):
                    data = (text or "").encode()
                    gone = merged(starts or [], ends or [])
                    left = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in gone]], [*[s for s, _ in gone], len(data)]))
                    sizes.append(len(data))
                    removed.append(len(data) - len(left))
                    counts.append(len(gone))
                    rest.append(hashlib.sha256(left).hexdigest() if digest else left)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(rest, pa.string() if digest else pa.binary())],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")
