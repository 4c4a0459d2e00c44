"""Token counts of a piece vocabulary, merged in numpy.

A text is cut into pre-tokens where two neighbouring characters stand side by
side in no piece: no merge can cross such a place. The different pre-tokens of
a chunk lie one after the other in one array of symbols. In each round every
pre-token applies its best pair, all of them at once; what is left when no
pre-token has a pair any more are its tokens.

A pair is named by its two symbols and ranked by the piece it makes. Where the
piece makes no new pair of its own rank or better, all places of the best pair
in a pre-token merge in one round, the left one first where two overlap;
otherwise only the leftmost does. That is the order in which the vocabulary's
own library merges one pair after the other.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.words import mixed

MARK = "▁"  # stands for a space and in front of every text
LANES, CHUNK = 16, 1 << 19
NONE = np.int64(1 << 40)


class Pieces:
    """A piece vocabulary as arrays: symbols are single characters that occur
    in pieces and the pieces of several characters."""

    def __init__(self, model: bytes):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        score = {m.id_to_piece(i): m.get_score(i) for i in normal}
        same = sentencepiece.SentencePieceNormalizer(model_proto=model).normalize(" ﬁ①  é ")
        if same != f"{MARK * 2}ﬁ①{MARK * 2}é{MARK}":
            raise ValueError("the vocabulary changes texts in another way than by a mark for spaces")
        chars = sorted({c for p in score for c in p})
        self.symbol = {c: i for i, c in enumerate(chars)}
        long = [p for p in score if len(p) > 1]
        self.symbol.update((p, len(chars) + i) for i, p in enumerate(long))
        self.lookup = np.full(max(map(ord, chars)) + 2, len(chars), np.int32)  # the last entry stands for all later characters
        self.lookup[[ord(c) for c in chars]] = np.arange(len(chars))
        if not all(c in score for c in chars):
            raise ValueError("a character of the pieces is no piece itself")
        self.mark = self.symbol[MARK]
        beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)  # the last stands for all other characters
        rank = {s: i for i, s in enumerate(sorted({score[p] for p in long}, reverse=True))}
        keys, values, makes = [], [], []
        for p in long:
            for a, b in pairwise(p):
                beside[self.symbol[a], self.symbol[b]] = True
            for k in range(1, len(p)):
                left, right = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank[score[p]])
                    makes.append(self.symbol[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.makes = (np.array(x, np.int64)[order] for x in (keys, values, makes))
        self.beside = beside
        # pieces that make a pair of their own rank or better when they are made
        own = np.full(len(self.symbol), NONE)
        own[self.makes] = self.ranks
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.hasty = np.zeros(len(self.symbol), bool)
        for side in (left, right):
            self.hasty[side[self.ranks <= own[side]]] = True
        # a run of marks joins from the left up to the longest piece of marks, after all else
        marks = {len(p): score[p] for p in long if set(p) == {MARK}}
        last = min(score[p] for p in long)
        self.block = max(marks) if marks and set(marks.values()) == {last} and not any(MARK * 2 in p for p in long if set(p) != {MARK}) and max(marks) == LANES else 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made symbol of pairs; rank `NONE` where no piece is made."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.makes[at], -1)


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Pieces:
    return Pieces(model)


def merged(pieces: Pieces, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many symbols are left of each sequence; sequences lie one after the
    other in `symbols`, none is empty."""
    n = len(starts)
    left_over = np.diff(np.append(starts, len(symbols)))
    if not n:
        return left_over
    owner = np.repeat(np.arange(n), left_over)
    rank, make = pieces.pairs(symbols[:-1], symbols[1:])
    rank, make = np.append(rank, NONE), np.append(make, -1)
    rank[np.append(starts[1:], len(symbols)) - 1] = NONE
    while True:
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(rank, first)
        # sequences without a pair are done
        live = np.repeat(best < NONE, np.diff(np.append(first, len(owner))))
        if not live.all():
            symbols, owner, rank, make = symbols[live], owner[live], rank[live], make[live]
            if not len(owner):
                return left_over
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = best[best < NONE]
        sizes = np.diff(np.append(first, len(owner)))
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        # only the leftmost place of a hasty piece; of places that overlap every other one
        seq = owner[at]
        lead = np.append(True, seq[1:] != seq[:-1])
        hasty = pieces.hasty[make[at]]
        if hasty.any():
            some = np.zeros(n, bool)
            some[seq[hasty]] = True
            at = at[lead | ~some[seq]]
        head = np.append(True, np.diff(at) > 1)
        run = np.flatnonzero(head)[np.cumsum(head) - 1]
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbols[at] = make[at]
        left_over -= np.bincount(owner[at], minlength=n)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        at = place[at]
        symbols, owner, rank, make = symbols[keep], owner[keep], rank[keep], make[keep]
        touched = np.zeros(len(symbols), bool)
        touched[at] = touched[at[at > 0] - 1] = True
        fresh = np.flatnonzero(touched)
        inner = fresh[fresh + 1 < len(symbols)]
        rank[inner], make[inner] = pieces.pairs(symbols[inner], symbols[inner + 1])
        rank[fresh[owner[np.minimum(fresh + 1, len(owner) - 1)] != owner[fresh]]] = NONE
        rank[-1] = NONE


def counted(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts])
    code = np.frombuffer("".join(MARK + t for t in texts if t).replace(" ", MARK).encode("utf-32-le"), np.uint32)
    if not len(code):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    raw = np.array([len(t.encode()) for t in texts])
    sym = pieces.lookup[np.minimum(code, len(pieces.lookup) - 1)]
    cut = np.append(True, ~pieces.beside[sym[:-1], sym[1:]])
    cut[1:] |= own[1:] != own[:-1]
    if pieces.block:  # long runs of marks, in blocks from their start, but for their last mark
        mark = sym == pieces.mark
        begins = np.flatnonzero(mark & np.append(True, ~mark[:-1] | (own[1:] != own[:-1])))
        ends = np.flatnonzero(mark & np.append(~mark[1:] | (own[1:] != own[:-1]), True)) + 1
        for a, b in zip(begins[ends - begins > pieces.block], ends[ends - begins > pieces.block]):
            cut[a + pieces.block:b:pieces.block] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(sym)))
    tokens = np.zeros(len(start), np.int64)
    one = length == 1
    known = sym[start[one]] < len(pieces.beside) - 1
    tokens[one] = np.where(known, 1, width[start[one]])  # other characters count as bytes
    for some in (~one & (length <= LANES), length > LANES):
        group = np.flatnonzero(some)
        if not len(group):
            continue
        if length[group[0]] <= LANES:  # equal ones once: sorted by a hash, then compared
            cell = start[group][:, None] + np.arange(LANES)
            inside = np.arange(LANES) < length[group][:, None]
            lanes = np.where(inside, sym[np.minimum(cell, len(sym) - 1)] + 1, 0).astype(np.uint16).view(np.uint64)
            h = lanes[:, 0]
            for i in range(1, lanes.shape[1]):
                h = mixed(h) ^ lanes[:, i]
            order = np.argsort(mixed(h), kind="stable")
            new = np.append(True, (lanes[order[1:]] != lanes[order[:-1]]).any(1))
            which = np.empty(len(group), np.int64)
            which[order] = np.cumsum(new) - 1
            once = group[order[new]]
        else:
            which, once = np.arange(len(group)), group
        sizes_once = length[once]
        begin = np.append(0, np.cumsum(sizes_once)[:-1])
        flat = np.repeat(start[once] - begin, sizes_once) + np.arange(int(sizes_once.sum()))
        tokens[group] = merged(pieces, sym[flat].astype(np.int64), begin)[which]
    return raw, np.bincount(own[start], tokens, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, model: bytes, limit: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    Null and empty texts have no tokens; repeated rows stay; ids, null or not,
    are carried along; other columns of whatever name are not read; an empty
    table gives an empty one. The vocabulary is sent along, as large as its
    file. A text is counted whole, by one task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(sent.value)
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, weight = [], 0
                while first + len(texts) < batch.num_rows and (not texts or weight < CHUNK):
                    texts.append(batch.column(1)[first + len(texts)].as_py() or "")
                    weight += len(texts[-1])
                raw, tokens = counted(pieces, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(raw, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                                                 [id, "n_bytes", "n_tokens", "over_limit"])
                first += len(texts)

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
