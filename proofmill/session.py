"""Session settings the jobs are tuned for."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | None = None, app: str = "proofmill") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. One process, as in tests,
    may do with a scratch folder; executors elsewhere could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="proofmill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def lit_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of plan-time constants: as large as the source text that
    lists them, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame written once to the shared folder and read back: for small
    tables several branches of a plan need, and to cut long lineage."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
