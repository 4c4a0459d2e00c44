"""Byte-level BPE by a rank file: whole texts to ids and back.

Each match of the split pattern is merged on its own, without special tokens.
Nulls and empty texts have no ids. The rank file is read where the query is
written and sent along (its size is that of a vocabulary, never of the data).
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 1 << 15
# A word never takes the space behind it, and the space in front of a word
# starts a match: cutting there cannot change any match.
_SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})")


@lru_cache(maxsize=4)
def encoding(rank_file: bytes, pattern: str):
    import tiktoken
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text cut at safe boundaries into parts of `long` characters or, where
    no boundary comes, as much more as it takes."""
    at = 0
    while len(text) - at > long:
        cut = _SAFE.search(text, at + long)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc, pattern: str, text: str) -> np.ndarray:
    ids: list[int] = []
    for part in pieces(text):
        if len(part) <= 4 * LONG:
            ids.extend(enc.encode_ordinary(part))
        else:  # no boundary in sight: match by match, out of reach of the matcher's step limit
            for m in regex.finditer(pattern, part):
                ids.extend(enc.encode_ordinary(m[0]) if len(m[0]) <= LONG else enc._encode_single_piece(m[0]))
    return np.asarray(ids, "<u4")


def tokens(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows of `docs` as (id, ids binary, decoded binary): the ids as
    little-endian unsigned 32-bit integers, and the bytes they decode to.

    Null and empty texts give empty values; repeated rows stay; other columns
    of whatever name are not read.
    """
    return _mapped(docs, rank_file, pattern, text, id, False)


def token_digests(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """As `tokens`, with counts and digests in place of ids and bytes."""
    return _mapped(docs, rank_file, pattern, text, id, True)


def _mapped(docs: DataFrame, rank_file: bytes, pattern: str, text: str, id: str, digests: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rank_file)
    kind = docs.schema[id].dataType.simpleString()
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value, pattern)
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [encode(enc, pattern, t or "") for t in rows.column(1).to_pylist()]
                raw = [enc.decode_bytes(x.tolist()) for x in found]
                if digests:
                    out = [pa.array([len(x) for x in found], pa.int64()),
                           pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())]
                else:
                    out = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([rows.column(0), *out], [id, *[c.split()[0] for c in columns.split(", ")]])

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, f"`{id}` {kind}, {columns}")
