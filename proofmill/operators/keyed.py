"""Per-key building blocks that hold up when one key owns most of the rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.session import kept


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null, keeping the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def spread(df: DataFrame) -> DataFrame:
    """Groups about to be worked on number by number, spread over all tasks.

    Adaptive execution packs partitions by bytes; a few thousand small rows
    would land in one task although each costs a millisecond of arithmetic. A
    named number of partitions is kept. Only grouped rows pass through here.
    """
    keys = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t][:6]
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def latest_per(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order. The rank filter is pushed
    below the shuffle (a group limit), so each task sends one row per key."""
    keys = [key] if isinstance(key, str) else key
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def newest_per(df: DataFrame, key: str | list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each key; the group limit applies here too."""
    keys = [key] if isinstance(key, str) else key
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def count_by(df: DataFrame, key: str, keys: DataFrame, name: str = "count") -> DataFrame:
    """How many rows each of `keys` has, zero included."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return keys.select(key).distinct().join(counts, key, "left").select(
        key, F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name))


def keys_with(df: DataFrame, key: str) -> DataFrame:
    """The keys that have at least one row."""
    return df.filter(F.col(key).isNotNull()).select(key).distinct()


def slice_of(column: str, width: int) -> Column:
    """Whole-number slices of an ordering column; with unique values no slice
    of a key holds more than `width` rows."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def _before(sizes: DataFrame, keys: list[str], slice_name: str, amounts: list[str]) -> DataFrame:
    earlier = W.partitionBy(*keys).orderBy(slice_name).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(*keys, slice_name, *[
        F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_before{a}") for a in amounts])


def number_within(df: DataFrame, keys: list[str], order: list, slices: Column,
                  name: str = "number") -> DataFrame:
    """1, 2, 3, ... per key by a total order, without one task per key.

    `slices` cuts the order into consecutive pieces. Rows are counted per
    (key, slice), the counts are added up over the few slices of a key, and
    rows are numbered inside their own slice. Keys must not be null.
    """
    sliced = df.withColumn("_slice", slices)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(sizes, keys, "_slice", ["_n"])
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    return (sliced.withColumn("_inside", inside)
            .join(offsets, [*keys, "_slice"])
            .withColumn(name, (F.col("_inside") + F.col("_before_n")).cast("long"))
            .drop("_slice", "_inside", "_before_n"))


def running_before(df: DataFrame, keys: list[str], order: list, slices: Column,
                   amounts: list[str]) -> DataFrame:
    """Adds `before_<amount>`: the sum over all earlier rows of the key. Sliced
    the same way as `number_within`. Keys must not be null."""
    sliced = df.withColumn("_slice", slices)
    sizes = sliced.groupBy(*keys, "_slice").agg(*[F.sum(a).alias(a) for a in amounts])
    offsets = _before(sizes, keys, "_slice", amounts)
    earlier = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = sliced
    for a in amounts:
        out = out.withColumn(f"_in_{a}", F.coalesce(F.sum(a).over(earlier), F.lit(0)))
    out = out.join(offsets, [*keys, "_slice"])
    for a in amounts:
        out = out.withColumn(f"before_{a}", F.col(f"_in_{a}") + F.col(f"_before{a}"))
    return out.drop("_slice", *[f"_in_{a}" for a in amounts], *[f"_before{a}" for a in amounts])


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """1, 2, 3, ... over the whole table by a total order.

    Rows are dealt by ranges of the order, which evens them out whatever the
    values are, and written; the ranges' sizes, one number a partition, are
    added up on the driver; rows are numbered inside their range. No task sees
    more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    before, starts = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect()):
        starts.append((r[0], before))
        before += r[1]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _before long"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (dealt.withColumn("_inside", inside).join(offsets, "_range")
            .withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before"))
