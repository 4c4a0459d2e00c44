"""Mixing sources to target weights, by word counts.

The words of a source form one stream: its documents in the order of a hash,
as often over as the target asks (twice at most). The stream is cut into
blocks of `BLOCK_WORDS`; a source gives its first blocks up to its target.
A binary tree deals the blocks to output shards: a node halves its shards, and
how many blocks of each source go left is drawn from the multivariate
hypergeometric law, source after source, so every shard has its exact number
of blocks and every source its exact quota. The shards take disjoint runs of a
source's permuted blocks; inside a shard the hash order mixes the sources.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.llm.tables import written

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
BLOCK_WORDS, LEVELS, SLICE_ROWS, TASKS_A_SHARD, SEED = 256, 4, 1000, 8, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size): `share` of
    all words by weight, no source above `repeats` times its own size.

    What a full source leaves is shared among the others by weight. Sources
    fill in the order of size over weight, so one pass over them in that order
    finds the full ones. One row per source, by code point, null last.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(order)
    weighed = sizes.withColumn("place", number).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    filling = W.orderBy(F.col("most") / F.col("weight"), "place")
    everything = W.partitionBy(F.lit(1))
    planned = (weighed.withColumn("most", repeats * F.col("source_size"))
               .withColumn("all", share * F.sum("source_size").over(everything))
               .withColumn("before", F.coalesce(F.sum("most").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("left", F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)))
               .withColumn("full", F.col("most") / F.col("weight") <= (F.col("all") - F.col("before")) / F.col("left"))
               .withColumn("rest", F.col("all") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything))
               .withColumn("sharing", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("sharing"))
    return planned.select("source", "source_size", "place", target.alias("target"))


def _drawn(total: Column, own: Column, taken: Column, chance: Column) -> Column:
    """How many of `taken` draws without replacement from `total` blocks fall on
    `own` of them, at the quantile `chance`. Terms over 12 deviations from the
    middle are below rounding and left out."""
    n, k, m = F.greatest(total, F.lit(1)).cast("double"), own.cast("double"), taken.cast("double")
    middle = F.floor((m + 1) * (k + 1) / (n + 2))
    width = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0))))) + 2
    low = F.greatest(F.lit(0), taken - (total - own), middle - width).cast("long")
    high = F.least(taken, own, middle + width).cast("long")

    def following(weight: Column, x: Column) -> Column:
        x = x.cast("double")
        return weight * (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    terms = F.sequence(low, high)
    whole = F.aggregate(terms, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
                        lambda a, x: F.struct(following(a["w"], x).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"])
    passed = F.aggregate(terms, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"), (chance * whole).alias("goal")),
                         lambda a, x: F.struct(following(a["w"], x).alias("w"), (a["s"] + a["w"]).alias("s"),
                                               (a["c"] + F.when(a["s"] + a["w"] < a["goal"], 1).otherwise(0)).alias("c"), a["goal"].alias("goal")), lambda a: a["c"])
    return F.when(low >= high, low).otherwise(F.least(low + passed, high))


def shard_quotas(quotas: DataFrame, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """(place, ends): for each source the block number where each shard's run
    ends, from (place, blocks). The tree holds one number per node and source."""
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "blocks"))).alias("own")).withColumn("node", F.lit(1).cast("long"))
    for _ in range(levels):
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        tree = tree.withColumn("_total", total)
        start = F.struct(F.floor((F.col("_total") + 1) / 2).cast("long").alias("n"), F.col("_total").alias("t"),
                         F.array().cast("array<struct<place:int,blocks:bigint>>").alias("own"))

        def step(a: Column, x: Column) -> Column:
            chance = (F.pmod(F.xxhash64(F.lit(seed), F.col("node"), x["place"]), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
            got = _drawn(a["t"], x["blocks"], a["n"], chance).cast("long")
            return F.transform(F.array(got), lambda g: F.struct(
                (a["n"] - g).alias("n"), (a["t"] - x["blocks"]).alias("t"),
                F.concat(a["own"], F.array(F.struct(x["place"].alias("place"), g.alias("blocks")))).alias("own")))[0]

        left = F.aggregate("own", start, step, lambda a: a["own"])
        tree = tree.withColumn("_left", left).withColumn(
            "_right", F.zip_with("own", "_left", lambda a, b: F.struct(a["place"].alias("place"), (a["blocks"] - b["blocks"]).alias("blocks"))))
        tree = tree.select(F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), F.col("_left").alias("own")),
                                             F.struct((2 * F.col("node") + 1).alias("node"), F.col("_right").alias("own")))).alias("_x")).select("_x.*")
    runs = tree.select(F.col("node"), F.explode("own").alias("_x")).select("node", "_x.place", "_x.blocks")
    ends = F.sum("blocks").over(W.partitionBy("place").orderBy("node"))
    return runs.withColumn("_end", ends).groupBy("place").agg(F.array_sort(F.collect_list("_end")).alias("ends"))


def plan(docs: DataFrame, carried: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """Each row of `docs` with size, source_size, target, taken (its words in the
    mix, repeats counted), `copies` (whole times) and `part` (words of one more);
    `carried` names further columns to keep.

    `at` is its first word's place in the source's stream, `ends` where the runs
    of the shards end, in blocks. A null or empty text has size 0 and is never taken; a source without words
    has target 0. Null sources form one source, the last. Rows of one document
    id are separate rows of the stream. The result depends on ids and texts only.
    """
    own = docs.select("doc_id", "source", *[F.col(c).alias(f"_keep_{c}") for c in carried], words_in(F.col("text")).alias("size"),
                      F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"))
    sized = written(own.select("source", "size", "_key"), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    aims = targets(by_source.select("source", "source_size"), weights, share)
    aims = aims.join(by_source.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    aims = aims.withColumn("_quota", F.floor("target").cast("long")).withColumn("_slices", F.ceil(F.col("_rows") / SLICE_ROWS).cast("long"))
    aims = written(aims, "targets")
    ends = shard_quotas(aims.select("place", F.ceil(F.col("_quota") / BLOCK_WORDS).cast("long").alias("blocks")), levels, seed)
    aims = written(aims.join(ends, "place").withColumnRenamed("source", "_s"), "quotas")

    def sliced(df: DataFrame) -> DataFrame:
        u = F.conv(F.substring("_key", 1, 13), 16, 10).cast("double") / float(1 << 52)
        return df.join(aims, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_slice", F.floor(u * F.col("_slices")).cast("long"))

    slices = sliced(sized).groupBy("place", "_slice").agg(F.sum("size").alias("_words"))
    slices = slices.withColumn("_first", F.sum("_words").over(W.partitionBy("place").orderBy("_slice")) - F.col("_words")).drop("_words")
    within = W.partitionBy("place", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sliced(own).join(slices, ["place", "_slice"]).withColumn("_at", F.col("_first") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    quota, size, at, words = F.col("_quota"), F.col("size"), F.col("_at"), F.col("source_size")
    copies = F.when(words > 0, F.floor(quota / words)).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(size, quota - copies * words - at)).cast("long")
    placed = placed.withColumn("copies", F.when(size > 0, copies).otherwise(0).cast("long")).withColumn("part", part)
    taken = (size * F.col("copies") + F.col("part")).cast("long")
    return placed.select("doc_id", "source", *[F.col(f"_keep_{c}").alias(c) for c in carried], "size", "source_size", "target", taken.alias("taken"),
                         "copies", "part", F.col("_at").alias("at"), "ends", F.col("_key").alias("key"))


def dealt(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of `docs` and `shard`, a row for each time a
    document is taken; a copy goes to the shard that owns the block it begins
    in. Shards are spread over tasks and shuffled inside them.

    The one document at which a source's target falls is cut after its last
    word in the mix; n_chars, where there is one, follows.
    """
    columns = docs.columns
    held = [c for c in columns if c not in ("doc_id", "source")]
    out = plan(docs.withColumnsRenamed({c: f"_own_{c}" for c in held if c != "text"}), tuple(f"_own_{c}" if c != "text" else c for c in held), **options)
    whole = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(whole, 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    times = F.concat(F.array_repeat(F.lit(True), F.col("copies").cast("int")),
                     F.when(F.col("part") > 0, F.array(F.col("part") == F.col("size"))).otherwise(F.array().cast("array<boolean>")))
    out = out.select("*", F.posexplode(times).alias("_time", "_whole"))
    block = F.floor((F.col("at") + F.col("_time") * F.col("source_size")) / BLOCK_WORDS)
    out = out.withColumn("shard", F.size(F.filter("ends", lambda e: e <= block)).cast("int"))
    out = out.withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("_own_n_chars", F.when(F.col("_whole"), F.col("_own_n_chars")).otherwise(length))
    mix = F.xxhash64("key", "_time")
    tasks = F.pmod(mix, F.lit(TASKS_A_SHARD))
    out = out.withColumn("_mix", mix).repartition("shard", tasks).sortWithinPartitions("shard", "_mix")
    return out.select(*[F.col(c) if c in ("doc_id", "source", "text") else F.col(f"_own_{c}").alias(c) for c in columns], "shard")
