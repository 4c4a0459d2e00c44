"""Tables an operator writes for itself, and rows with a stable key."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.session import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: it cuts the lineage,
    outlives lost executors, and is computed once."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bits(column) -> Column:
    """Hash of a text wide enough to stand for it: 128 bits as two longs."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def boxed(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns `own`, and all others in one struct `_row`, where no name of
    theirs can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*[c for c in own if c in docs.columns], (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("_row"))


def unboxed(df: DataFrame, columns: list[str], *more: Column, own: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns of a boxed table by their names again, and `more`."""
    return df.select(*[F.col(c) if c in own else F.col(f"_row.`{c}`").alias(c) for c in columns], *more)
