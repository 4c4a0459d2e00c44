"""Documents to tokens: quality rules, line dedup, near-dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each stage's rows to the shared folder and reads them as the next one's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import bpe, mixing, probminhash, quality, templates
from proofmill.llm.queries import vocabulary
from proofmill.llm.tables import boxed, table, unboxed, written


OWN = ("doc_id", "text", "source", "n_chars")  # columns the stages read; all others travel in one struct


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go, repeated
    rows are judged alike, an empty table stays empty; without labels of both
    kinds the base rules alone decide."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = boxed(docs, OWN)
    return unboxed(quality.judged(held, model, tuple(held.columns)).filter("kept"), docs.columns, own=OWN)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those that lose all their lines go.
    Null and empty texts stay, repeated rows lose the same lines, a null id is
    a document of its own."""
    out = templates.cleaned(boxed(docs, OWN))
    left = out.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return unboxed(left, docs.columns, own=OWN)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest
    id. Rows without an id stay."""
    firsts = probminhash.classes(docs).filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    rows = docs.join(firsts.hint("merge"), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    return rows.dropDuplicates(["doc_id", "text"]).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shuffled in shards.
    Null and empty texts are never taken, repeated rows are taken each on its
    own, null sources are one source, an empty table stays empty."""
    return unboxed(mixing.dealt(boxed(docs, OWN)), docs.columns, own=OWN)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix, a row for each of
    its rows; null and empty texts have no tokens."""
    return bpe.token_digests(docs, *vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
# Classifier, buckets and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
