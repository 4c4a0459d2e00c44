"""Periodic runs of words by maximal pairs.

A run of period q that begins at word i gives the pair (i, i + q): the same
words follow both places, as many as the run is longer than q; the words in
front of the two differ, and so do the words behind the common part. Such a
pair is maximal, it meets at the node of the suffix tree whose depth is the
length of the common part, and wherever that length reaches the distance, the
pair is a run: nothing needs to be extended.

The suffix tree is walked as intervals of the LCP array, deepest first. Every
node holds its places in the order of the text, each with its class, the word
in front. Children are joined, the smaller list into the larger one; places
of two children that become neighbours there, differ in class and are near
enough are the node's pairs. A place between the two would give both a smaller
period, so neighbours are all that count; of several periods of one stretch
the smallest stays.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12  # words of the shortest run


def _coded(words: list[bytes]) -> np.ndarray:
    codes: dict[bytes, int] = {}
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))


def _places(ids: np.ndarray, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first `common` words or more with another one,
    in suffix order, and the common length of each with the one before it.

    Prefix doubling; a suffix that is alone at some width is done with.
    """
    n, none = len(ids), np.zeros(0, np.int64)
    levels, width = [], 1
    rank = np.full(n + 1, -1, np.int64)  # behind the end stands -1
    rank[:n] = ids
    still, group = np.arange(n), np.zeros(n, np.int64)
    last = None
    while True:
        # split the groups of `still` by the rank that follows
        key = group * (n + 1) + (rank[still] if width == 1 else rank[np.minimum(still + width // 2, n)]) + 1
        by = np.argsort(key, kind="stable")
        still, key = still[by], key[by]
        head = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(still)))
        # a group's number is the place of its first suffix among all
        begin = np.append(True, group[by][1:] != group[by][:-1])
        base = (group[by] - np.flatnonzero(begin)[np.cumsum(begin) - 1])
        number = np.repeat(first, size) + base
        rank = rank.copy()
        rank[still] = number
        levels.append((width, rank))
        open_ = np.repeat(size > 1, size)
        if last is None and width * 2 > common:
            # those that share `common` words: their first half and the one that ends with them
            half = rank[still] * (n + 1) + rank[np.minimum(still + common - width, n)] + 1
            values, counts = np.unique(half, return_counts=True)
            shared = counts[np.searchsorted(values, half)] > 1
            if not shared.any():
                return none, none
            last = still[shared]
        if not open_.any():
            break
        still, group = still[open_], number[open_]
        width *= 2
    if last is None:
        return none, none
    order = last[np.argsort(levels[-1][1][last], kind="stable")]
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)
    for width, rank in reversed(levels):
        same = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (a < n) & (b < n)
        step = same * width
        a, b, out = a + step, b + step, out + step
    return order, np.append(0, out)


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` symbols and two
    periods, by start, then period."""
    common = -(-least // 2)
    if len(ids) < least:
        return []
    order, lcp = _places(ids, common)
    if not len(order):
        return []
    front = [-1, *ids[:-1].tolist()]  # the word in front of each place
    found: dict[tuple[int, int], int] = {}

    def pair(x: int, y: int, depth: int) -> None:
        gap = y - x
        if gap <= depth and gap + depth >= least and (x == 0 or front[x] != front[y]):
            stretch = (x, gap + depth)
            found[stretch] = min(gap, found.get(stretch, gap))

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        for p in small:
            k = bisect_left(big, p)
            if k:
                pair(big[k - 1], p, depth)
            if k < len(big):
                pair(p, big[k], depth)
        if len(small) * 8 < len(big):
            for p in small:
                insort(big, p)
        else:
            big += small
            big.sort()
        return big

    stack: list[tuple[int, list[int]]] = []
    node: list[int] = []
    for place, depth in zip(order.tolist(), lcp.tolist()):
        while stack and stack[-1][0] > depth:
            deep, held = stack.pop()
            node = join(held, node, deep)
        if depth >= common:
            if stack and stack[-1][0] == depth:
                stack[-1] = depth, join(stack[-1][1], node, depth)
            else:
                stack.append((depth, node))
        node = [place]
    while stack:
        deep, held = stack.pop()
        node = join(held, node, deep)
    return [(start, length, q) for (start, length), q in sorted(found.items(), key=lambda x: (x[0][0], x[1]))]


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, reread: Callable[[object, list[bytes]], list[bytes]] | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) for
    each row of `docs`: its runs, and its words, joined by single spaces,
    without what runs repeat.

    `reread` may change a document's words before they are searched. Words are
    parted by space and the characters 09 to 0D. Null and empty texts have no
    words and no runs; repeated rows stay, null ids too; other columns of
    whatever name are not read; an empty table gives an empty one. A text is
    searched whole, by one task.
    """
    kind = docs.schema[id].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sizes, all_runs, rest = [], [], []
                for key, value in zip(rows.column(0).to_pylist(), rows.column(1)):
                    words = (value.as_py() or "").encode().split()
                    if reread:
                        words = reread(key, words)
                    found = runs(_coded(words), least)
                    if found:
                        keep = collapsed(len(words), found)
                        kept = [w for w, k in zip(words, keep.tolist()) if k]
                    sizes.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    rest.append(b" ".join(kept if found else words).decode())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, run_type), pa.array(rest, pa.string())],
                                                 [id, "n_words", "runs", "collapsed"])

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, f"`{id}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
