"""Parquet folders for every table, with the declared schema."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES

# how big tables are laid out: by batch, so one batch's results are one folder
PARTITIONED = {"check_results": ["batch_id"], "runs": ["batch_id"]}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def save(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Rows are spread by the layout column and a second key before writing, so
    a batch with most of the rows is written by many tasks."""
    layout = PARTITIONED.get(name)
    if layout:
        spread = [c for c in ("entry_id", "run_id") if c in df.columns][:1]
        df = df.repartition(*layout, *spread)
        df.write.mode(mode).partitionBy(*layout).parquet(f"{folder}/{name}")
    else:
        df.write.mode(mode).parquet(f"{folder}/{name}")
