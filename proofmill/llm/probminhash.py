"""Near duplicates by ProbMinHash over weighted five-word shingles.

Every different shingle of a text weighs 1 + ln(times it occurs). It sends a
Poisson process of arrivals whose rate is its weight; each arrival falls on
one of `SLOTS` slots, and a slot keeps the shingle that came first. A shingle
stops as soon as its next arrival is later than every slot's first, so long
texts need hardly more than one arrival each. Two texts agree in a slot with
the chance of their probability Jaccard. Bands of `ROWS` slots bring likely
pairs together; each is then compared exactly, and linked when the Jaccard of
its five-word shingles is at least 0.8. That Jaccard has no weights, so every
text has bands over weights of 1; a text with repeated shingles has the
weighted ones as well.

Texts of the same words are one text from the start. The members of a bucket
are first compared with its leader: the member whose own buckets are the
fullest, hence the text the others were copied from. Buckets also split by one
and by two further bands, each part with a leader of its own. The links so far
make groups. What is left are the buckets whose members are in several groups:
their texts meet by an exact prefix filter. Every text puts its shingles in one
common order, rare ones first. Of a pair at 0.8 or more the longer text has one
of its first n - ceil(0.8 n) + 1 shingles among the first n - ceil(8/9 n) + 1
of the other, where n is either text's own number. So a bucket of copies costs
one comparison a member, texts that share but a passage meet nowhere, and no
pair of a bucket is left out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.llm.groups import connected
from proofmill.llm.tables import written
from proofmill.llm.words import Words, chunks, mixed, words

SHINGLE, SLOTS, ROWS, SPLITS, PART = 5, 96, 4, 3, 1024
BANDS = SLOTS // ROWS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(52)
_ALL = (1 << 64) - 1


def shingles(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of a chunk's texts: text, hash of 52 bits, times.
    A text of fewer than five words is one shingle."""
    at, h = found.grams(SHINGLE)
    text = found.text[at]
    short = np.flatnonzero((found.counts > 0) & (found.counts < SHINGLE))
    if len(short):
        first = np.searchsorted(found.text, short)
        whole = np.zeros(len(short), np.uint64)
        for i in range(SHINGLE - 1):
            more = found.counts[short] > i
            whole[more] = mixed(whole[more] * _ODD + found.hash[first[more] + i])
        text, h = np.concatenate([text, short]), np.concatenate([h, whole])
    key = np.sort(text.astype(np.uint64) << _TOP | h >> np.uint64(12))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[new] >> _TOP).astype(np.int64), key[new] & np.uint64((1 << 52) - 1), np.diff(np.append(new, len(key)))


def signatures(text: np.ndarray, shingle: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Slots of n texts: the shingle that arrives first in each."""
    first = np.full((n, SLOTS), np.inf)
    who = np.zeros((n, SLOTS), np.uint64)
    flat_first, flat_who = first.ravel(), who.ravel()
    rate, seed, clock = 1 + np.log(times), mixed(shingle + np.uint64(1)), np.zeros(len(text))
    step = 0
    while len(text):
        step += 1
        draw = mixed(seed + np.uint64(2 * step * int(_ODD) & _ALL))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)) / rate
        slot = text * SLOTS + (mixed(seed + np.uint64((2 * step + 1) * int(_ODD) & _ALL)) % np.uint64(SLOTS)).astype(np.int64)
        won = np.flatnonzero(clock < flat_first[slot])
        won = won[np.argsort(-clock[won], kind="stable")]  # the earliest is written last
        flat_first[slot[won]] = clock[won]
        flat_who[slot[won]] = shingle[won]
        open_ = clock < first.max(axis=1)[text]
        text, shingle, rate, seed, clock = text[open_], shingle[open_], rate[open_], seed[open_], clock[open_]
    return who


def bands(who: np.ndarray) -> np.ndarray:
    """A bucket for each band of each text; bands never share a bucket."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(who), BANDS)).copy()
    for i in range(ROWS):
        h = mixed(h * _ODD + who[:, i::ROWS])
    return h.view(np.int64)


def banded(text: np.ndarray, shingle: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of n texts, one after the other, and where each text's begin
    and end: `BANDS` over weights of 1, then, for texts with repeated shingles,
    `BANDS` over their weights."""
    again = np.bincount(text, times > 1, n) > 0
    plain = bands(signatures(text, shingle, np.ones(len(text)), n))
    own = again[text]
    weighted = bands(signatures((np.cumsum(again) - 1)[text[own]], shingle[own], times[own], int(again.sum())))
    out = np.concatenate([plain, weighted])
    order = np.argsort(np.concatenate([np.arange(n), np.flatnonzero(again)]), kind="stable")
    return out[order].ravel(), np.append(0, np.cumsum(np.where(again, 2 * BANDS, BANDS)))


def sequence_keys(found: Words, n: int) -> np.ndarray:
    """Two hashes of the word sequence of each text."""
    out = np.zeros((2, n), np.uint64)
    if len(found.hash):
        own = np.flatnonzero(found.counts)
        first = np.searchsorted(found.text, own)
        place = (np.arange(len(found.text)) - np.repeat(first, found.counts[own])).astype(np.uint64)
        for lane in range(2):
            h = mixed(found.hash + (place + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[lane]))
            out[lane, own] = mixed(np.add.reduceat(mixed(h * np.uint64(2 * lane + 3)), first) + found.counts[own].astype(np.uint64))
    return out.view(np.int64)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(1), 1 << 20):
            for at in range(first, last, 2048):  # a shingle's key has 12 bits for its text
                upto = min(last, at + 2048)
                lo, hi = offsets[at - first], offsets[upto - first]
                found = words(data[lo:hi], offsets[at - first:upto - first + 1] - lo)
                n = upto - at
                keys = sequence_keys(found, n)
                text, shingle, times = shingles(found)
                lists, ends = banded(text, shingle, times, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(found.counts.astype(np.int64)), pa.array(np.bincount(text, minlength=n)), pa.array(keys[0]), pa.array(keys[1]),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lists))],
                                                 ["doc_id", "n_words", "n_shingles", "key_a", "key_b", "bands"])


def _unique(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts, counts = [], []
    for first, last, data, offsets in chunks(texts, 1 << 20):
        text, shingle, _ = shingles(words(data, offsets))
        parts.append((text + first).astype(np.uint64) << _TOP | shingle)
        counts.append(np.bincount(text, minlength=last - first))
    return np.concatenate(parts), np.concatenate(counts)


def similar(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Which texts have a Jaccard of their shingles of at least 0.8, row by row."""
    a, na = _unique(left)
    b, nb = _unique(right)
    both = np.sort(np.concatenate([a, b]))
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> _TOP).astype(np.int64), minlength=len(na))
    return (5 * shared >= 4 * (na + nb - shared)) & (na + nb > 0)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different shingle of each text."""
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text"), 1 << 20):
            for at in range(first, last, 2048):
                upto = min(last, at + 2048)
                lo, hi = offsets[at - first], offsets[upto - first]
                text, shingle, _ = shingles(words(data[lo:hi], offsets[at - first:upto - first + 1] - lo))
                rows = batch.select(["rep", "version", "root", "size"]).take(pa.array(text + at))
                sizes = np.bincount(text, minlength=upto - at)[text]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sizes, pa.int64()), pa.array(shingle.view(np.int64))], ["rep", "version", "root", "size", "n", "shingle"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            keep = pa.array(similar(rows.column("text_a"), rows.column("text_b")))
            yield rows.select(["a", "b"]).filter(keep)


def buckets(texts: DataFrame) -> DataFrame:
    """(rep, fame, buckets) from (rep, bands): a row for
    each bucket that a text shares, the bucket first and then its finer parts;
    fame is how full the text's buckets are."""
    opened = texts.select("rep", "bands", F.posexplode("bands").alias("_band", "bucket"))
    # a band that the weights do not change is there once
    opened = opened.filter((F.col("_band") < BANDS) | (F.col("bucket") != F.get("bands", F.col("_band") - BANDS))).drop("bands")
    sizes = opened.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # joins that grow with the corpus shuffle at every size, so that small runs tell what large ones take
    members = opened.join(sizes.hint("merge"), "bucket").join(texts.select("rep", "bands").hint("merge"), "rep")
    lane = F.floor(F.col("_band") / BANDS) * BANDS
    nth = lambda i: F.element_at("bands", (lane + (F.col("_band") + i) % BANDS + 1).cast("int"))
    finer = F.array("bucket", *[F.xxhash64(F.lit(k), "bucket", *[nth(i) for i in range(1, k + 1)]) for k in range(1, SPLITS)])
    members = written(members.select("rep", "size", finer.alias("buckets")), "members")
    fame = members.groupBy("rep").agg(F.sum("size").alias("fame"))
    return members.join(fame, "rep").select("rep", "fame", "buckets")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def candidates(members: DataFrame) -> DataFrame:
    """(a, b): the members of each bucket and of its parts with their leader."""
    placed = members.select("rep", "fame", F.explode("buckets").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("rep")).alias("rep"))).alias("_top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _ordered(placed.join(leaders.select("bucket", (-F.col("_top.rep")).alias("b")), "bucket").filter("rep <> b"))


def unlike(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(rep, root, size): the texts of buckets whose members are in several
    groups of `roots`; size is how many of these texts the group has."""
    placed = members.select("rep", F.col("buckets")[0].alias("bucket"))
    placed = placed.join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed_ = placed.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("bucket")
    texts = written(placed.join(mixed_.hint("merge"), "bucket").select("rep", "root").distinct(), "unlike")
    return texts.join(texts.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").select("rep", "root", "size")


def others(docs: DataFrame, open_: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b): the pairs of the texts `open_`, in different groups, that may
    reach 0.8 by the prefix filter, but for the pairs `done`.

    A shingle that one group alone has brings nothing together. Of two groups
    one is not the largest at a shingle: only texts outside that one meet all
    others, a frequent shingle's texts dealt over tasks of `PART`. Whether the
    lengths allow 0.8, and whether enough shingles follow the shared one, is
    part of the join.
    """
    held = docs.select(F.col("doc_id").alias("rep"), "text", F.xxhash64("text").alias("version")).join(open_.hint("merge"), "rep")
    rows = written(held.mapInArrow(_opened, "rep long, version long, root long, size long, n long, shingle long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), F.max_by("root", F.struct("size", "root")).alias("_led"),
                                        F.min("root").alias("_low"), F.max("root").alias("_high")).filter("often > 1")
    often = often.select("shingle", "often", "_led", (F.col("_low") < F.col("_high")).alias("_several"))
    ranked = rows.drop("size").join(often.hint("merge"), "shingle", "left")
    place = F.dense_rank().over(W.partitionBy("rep", "version").orderBy(F.coalesce("often", F.lit(1)), "shingle"))  # rows may repeat
    ranked = ranked.withColumn("place", place.cast("long"))
    long, short = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1, F.col("n") - F.ceil(F.col("n") * 8 / 9) + 1
    front = ranked.filter((F.col("place") <= long) & F.col("_several")).select(
        "shingle", "rep", "version", "root", "n", "place", (F.col("place") <= short).alias("short"), "_led", F.ceil(F.col("often") / PART).cast("int").alias("_parts"))
    front = written(front.dropDuplicates(["shingle", "rep", "version"]), "fronts")
    inside = front.withColumn("_part", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int")).drop("_led", "_parts")
    outside = front.filter("root <> _led").select("shingle", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("rep").alias("b"),
                                                  F.col("root").alias("_root"), F.col("n").alias("_n"), F.col("place").alias("_place"), F.col("short").alias("_short"))
    left = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place")) + 1
    near = (F.col("root") != F.col("_root")) & (5 * F.least("n", "_n") >= 4 * F.greatest("n", "_n")) & (9 * left >= 4 * (F.col("n") + F.col("_n")))
    near &= F.when(F.col("n") >= F.col("_n"), F.col("_short")).otherwise(F.col("short"))
    met = inside.alias("x").join(outside.hint("merge").alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x._part") == F.col("y._part")) & near)
    return _ordered(met.select("rep", "b")).join(done.hint("merge"), ["a", "b"], "left_anti")


def linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts have a Jaccard of at least 0.8."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    held = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id")
    compared = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(
        held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return compared.mapInArrow(_verified, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row of `docs`: the smallest id of its group.

    Texts without words are in no group: their class is their own id. Rows
    that share an id are one document; a null id has a null class. Columns
    other than doc_id and text are not read.
    """
    prints = written(docs.select("doc_id", "text").mapInArrow(_printed, "doc_id long, n_words long, n_shingles long, key_a long, key_b long, bands array<long>"), "prints")
    worded = prints.filter("n_words > 0 and doc_id is not null")
    texts = written(worded.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "texts")
    members = written(buckets(texts), "buckets")
    pairs = written(candidates(members), "pairs")
    copies = worded.join(texts.select("key_a", "key_b", "rep"), ["key_a", "key_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    # an id's own texts, a text's copies and the compared pairs all link
    groups = written(connected(linked(docs, pairs).unionByName(copies.distinct())), "groups")
    rest = written(others(docs, unlike(members, groups), pairs), "others")
    roots = connected(linked(docs, rest).unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return docs.select("doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("class_id"))
