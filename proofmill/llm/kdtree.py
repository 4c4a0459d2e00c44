"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt to shards by a hash of their ids, so equal vectors spread
over all shards. A shard builds a tree of median splits along the widest side
of each node, with the tight bounding box of every node. A query walks the
tree from the node of the best bound on: the largest inner product any point
of the box could have. It stops when that bound falls below its k-th score.

Queries search their own shard first. The k-th score found there travels with
the query to the other shards, and only to those whose whole box can reach it.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.llm.tables import written

LEAF, SHARD_ROWS, BLOCK_QUERIES = 512, 8192, 2048
SCALE = 256


@dataclass
class Tree:
    """Points in the order of the leaves; nodes with their boxes, children (0: leaf) and runs of points."""

    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray
    end: np.ndarray


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(ids))
    low, high, left, right, start, end = [], [], [], [], [], []
    todo = [(0, len(ids), -1, False)]
    while todo:
        a, b, parent, is_right = todo.pop()
        node, own = len(low), points[order[a:b]]
        if parent >= 0:
            (right if is_right else left)[parent] = node
        low.append(own.min(0))
        high.append(own.max(0))
        left.append(0)
        right.append(0)
        start.append(a)
        end.append(b)
        side = int(np.argmax(high[-1] - low[-1]))
        if b - a > leaf and high[-1][side] > low[-1][side]:  # equal points stay together
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], middle)]
            todo += [(a, a + middle, node, False), (a + middle, b, node, True)]
    for a, b, kids in zip(start, end, left):
        if not kids:
            order[a:b] = np.sort(order[a:b])
    return Tree(ids[order], points[order], np.array(low), np.array(high), np.array(left), np.array(right), np.array(start), np.array(end))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:  # everything at the k-th score or above, ties included
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(tree: Tree, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best points but `own`, none needed below `floor`."""
    scores, ids, kth = np.zeros(0, tree.points.dtype), np.zeros(0, np.int64), floor
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < kth:
            break
        if tree.left[node]:
            for child in (tree.left[node], tree.right[node]):
                if bounds[child] >= kth:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        a, b = tree.start[node], tree.end[node]
        found, who = tree.points[a:b] @ query, tree.ids[a:b]
        keep = (found >= kth) & (who != own)
        if keep.any():
            scores, ids = _best(np.concatenate([scores, found[keep]]), np.concatenate([ids, who[keep]]), k)
            if len(scores) == k:
                kth = max(kth, scores[-1])
    return scores, ids


def _matrix(column: pd.Series) -> np.ndarray:
    """Whole numbers as doubles where every product and sum stays exact, else as longs."""
    m = np.array(column.tolist(), np.int64).reshape(len(column), -1)
    top = float(np.abs(m.astype(float)).max()) if m.size else 0.0
    return m.astype(float) if top * top * max(m.shape[1], 1) < 2.0 ** 52 else m


def searched(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one shard for each query of one block, as rows."""
    out = []
    if len(queries) and len(vectors):
        q, points = _matrix(queries["vector"]), _matrix(vectors["vector"])
        if q.dtype != points.dtype:
            q, points = q.astype(np.int64), points.astype(np.int64)
        vectors = vectors["vec_id"].to_numpy()
        tree = build(vectors, points)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = (up @ tree.high.T + down @ tree.low.T)
        floors = queries["kth"].to_numpy(float, na_value=-np.inf)
        for i, own in enumerate(queries["query_id"].to_numpy()):
            scores, ids = search(tree, q[i], bounds[i], own, k, floors[i])
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores.astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def whole(embedding: Column) -> Column:
    """floor(256 x) of every component; null for a vector that takes no part."""
    sound = embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows but its own for
    each row of `vectors` (vec_id, embedding) where `is_query` holds; ties go to
    the smaller vec_id.

    Vectors that are null or empty or hold a null or non-finite component take
    no part, nor do null ids. A vec_id that occurs more than once counts once,
    with the smallest of its vectors. Only vectors of one length are compared.
    An empty table gives no rows. Tasks hold one shard and one block of queries.
    """
    sound = vectors.select("vec_id", whole(F.col("embedding")).alias("vector"), is_query.alias("asks")).filter("vec_id is not null and vector is not null")
    # an id's smallest vector; the flag follows the id
    rows = sound.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    n = F.size("vector")
    rows = written(rows.withColumn("dim", n), "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    shards, blocks = max(1, -(-sizes["rows"] // shard_rows)), max(1, -(-sizes["queries"] // block_queries))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = dealt.filter("asks").select(F.col("vec_id").alias("query_id"), "vector", "dim", F.col("shard").alias("home"),
                                        F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"))
    schema = "query_id long, vec_id long, score long"
    keys = ["dim", "shard", "block"]

    def by_blocks(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(c) for c in ("vec_id", "vector", "dim", "shard")], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def find(queries: DataFrame, points: DataFrame) -> DataFrame:
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return searched(left, right, k)
        return queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(run, schema)

    home = asked.select("query_id", "vector", "dim", F.col("home").alias("shard"), "block", F.lit(None).cast("double").alias("kth"))
    near = written(find(home, by_blocks(dealt)), "near")
    kth = near.groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).select(
        "query_id", F.when(F.col("n") == k, F.col("score").cast("double")).alias("kth"))
    # box of each shard: the smallest and largest of each component
    sides = dealt.select("dim", "shard", F.posexplode("vector").alias("at", "x")).groupBy("dim", "shard", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    boxes = sides.groupBy("dim", "shard").agg(F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))).alias("box"))
    away = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home").join(boxes, ["dim", "shard"]).join(kth, "query_id", "left")
    bound = F.aggregate(F.zip_with("vector", "box", lambda q, b: F.greatest(q.cast("double") * b["lo"], q.cast("double") * b["hi"])), F.lit(0.0), lambda a, x: a + x)
    reach = away.filter(F.col("kth").isNull() | (bound >= F.col("kth"))).select("query_id", "vector", "dim", "shard", "block", "kth")
    far = find(reach, by_blocks(dealt))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.unionByName(far).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
