"""Similarity of precomputed vectors."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.numeric import let
from ...functions.text import strip

KEYS = ["run_id", "label"]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is missing."""
    length = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(a.isNotNull() & b.isNotNull(), let(length, lambda n: F.when(n > 0, _dot(a, b) / n).otherwise(0.0)))


def cosine_scores(checks: DataFrame, vectors: DataFrame) -> DataFrame:
    """raw_score per check. `vectors` has run_id, label, answer_vector and
    reference_vector; a blank answer scores 0."""
    score = F.when(strip(F.col("answer")) == "", 0.0).otherwise(cosine(F.col("answer_vector"), F.col("reference_vector")))
    return checks.join(vectors, KEYS, "left").select(*KEYS, score.alias("raw_score"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _greedy(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def unit(rows):
        m = np.stack([np.asarray(r, dtype="float64") for r in rows])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def one(answer, reference):
        if answer is None or reference is None or len(answer) < 3 or len(reference) < 3:
            return [0.0, 0.0]
        likeness = unit(answer) @ unit(reference).T
        # the markers at both ends may be matched but are not counted
        return [float(likeness[1:-1].max(axis=1).mean()), float(likeness[:, 1:-1].max(axis=0).mean())]

    for a, b in parts:
        yield pd.Series([one(x, y) for x, y in zip(a, b)])


token_match = _greedy  # (precision, recall) of two arrays of token vectors


def token_score(found: Column, measure: Column) -> Column:
    p, r = found[0], found[1]
    f1 = F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.when(measure == "precision", p).when(measure == "recall", r).otherwise(f1)


def token_vector_scores(tokens: DataFrame, measure: str = "f1", baseline: float | None = None) -> DataFrame:
    """Best match of every token vector. `tokens` has run_id, label, and the
    token vectors of one text each side as arrays; a model reads at most 512
    pieces, so the likeness table of a row is small and stays inside it."""
    got = tokens.select(*KEYS, _greedy("answer_vectors", "reference_vectors").alias("_s"))
    p, r = F.col("_s")[0], F.col("_s")[1]
    score = {"precision": p, "recall": r}.get(measure, F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0))
    if baseline is not None:
        score = (score - baseline) / (1 - baseline)
    return got.select(*KEYS, score.alias("raw_score"))


def collect_token_vectors(pieces: DataFrame) -> DataFrame:
    """Token rows (run_id, label, side, pos, vector) as arrays per text."""
    def side(name):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct("pos", "vector")))),
                           lambda t: t["vector"])
    return pieces.groupBy(*KEYS).agg(side("answer").alias("answer_vectors"), side("reference").alias("reference_vectors"))
