"""Largest-inner-product search with vantage-point trees.

Vectors get one more coordinate, sqrt(M^2 - |x|^2), after which Euclidean
nearness to a query (extended by 0) orders candidates exactly as the inner
product does.  Distinct vectors are dealt into shards; a shard is a tree of
nested balls around vantage points.  A branch is skipped when the triangle
inequality, relaxed by ``factor``, says that it holds nothing nearer than the
k-th found so far; factor 1 skips only what cannot matter and is exact.
A block of queries walks a tree together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Most vectors of a leaf, which are compared all together.
LEAF = 512
#: Distinct vectors of one tree.
SHARD_ROWS = 10_000
#: Most queries that meet one tree in one task, and that walk it together.
QUERY_BLOCK = 16_384
WALK = 1024
FACTOR = 1.5
#: Candidates kept beyond k before exact scoring, against rounding.
SPARE = 12


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: int = -1
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


def extend(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that turns inner products into distances."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0.0))
    return np.concatenate([x, rest[:, None]], 1)


def build(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Node:
    """A tree over ``rows`` of ``x``: the vantage point, of five tried, spreads distances most."""
    if len(rows) <= max(leaf, 5):
        return Node(rows=rows)
    tries = rng.choice(rows, 5, replace=False)
    some = x[rng.choice(rows, min(len(rows), 200), replace=False)]
    spread = [np.linalg.norm(some - x[t], axis=1).std() for t in tries]
    point = int(tries[int(np.argmax(spread))])
    d = np.linalg.norm(x[rows] - x[point], axis=1)
    order = np.argsort(d, kind="stable")
    half = len(rows) // 2
    radius = float(d[order[half]])
    return Node(point=point, radius=radius, inside=build(x, rows[order[:half]], rng, leaf), outside=build(x, rows[order[half:]], rng, leaf))


class Search:
    """The k' nearest of a tree for a block of queries."""

    def __init__(self, x: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.x, self.q, self.factor = x, q, factor
        self.xx, self.qq = (x * x).sum(1), (q * q).sum(1)
        self.best = np.full((len(q), k), np.inf)
        self.rows = np.full((len(q), k), -1, np.int64)

    def _leaf(self, node: Node, who: np.ndarray) -> None:
        d = self.xx[node.rows][None, :] - 2 * (self.q[who] @ self.x[node.rows].T) + self.qq[who][:, None]
        near = np.concatenate([self.best[who], np.sqrt(np.maximum(d, 0))], 1)
        rows = np.concatenate([self.rows[who], np.broadcast_to(node.rows, d.shape)], 1)
        k = self.best.shape[1]
        if near.shape[1] > k:
            pick = np.argpartition(near, k - 1, axis=1)[:, :k]
            near, rows = np.take_along_axis(near, pick, 1), np.take_along_axis(rows, pick, 1)
        self.best[who, : near.shape[1]], self.rows[who, : near.shape[1]] = near, rows

    def walk(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.rows is not None:
            self._leaf(node, who)
            return
        d = np.linalg.norm(self.q[who] - self.x[node.point], axis=1)
        within = d < node.radius
        self.walk(node.inside, who[within])
        self.walk(node.outside, who[~within])
        # what is left of the other side lies at least |d - radius| away
        far = self.best[who].max(1) >= self.factor * np.abs(d - node.radius)
        self.walk(node.outside, who[within & far])
        self.walk(node.inside, who[~within & far])


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed alike for equal vectors."""
    return np.einsum("ij,ij->i", q.astype(np.float64), x.astype(np.float64))


def usable(col: str) -> Column:
    v = F.col(col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda e: e != 0)


def search(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    Queries are the rows whose id is divisible by ``every``; every other row is
    a candidate, the query's own row is not.  Ties go to the smaller id.  Rows
    with a null id and vectors that are null, zero or of another length than
    most, or hold null or non-finite parts, take no part.  Equal vectors are
    one tree entry with the k+1 smallest of their ids, all that a result can
    ever name.  Rows that repeat an id and vector count once; a candidate id
    with several vectors counts with each, a query id with the first by digest.
    Other columns are not read.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "vptree")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    src = src.where(F.col("vec_id").isNotNull() & usable("v")).withColumn("key", F.sha1(F.array_join(F.transform("v", lambda e: (e + 0.0).cast("string")), ",")))
    src = ws.stage(src, "vectors")
    width = src.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").head(1)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    src = src.where(F.size("v") == width[0].w)
    # the smallest ids of each distinct vector: a group limit below the shuffle keeps hot vectors small
    by_vector = Window.partitionBy("key").orderBy("vec_id")
    few = src.select("key", "vec_id").withColumn("r", F.dense_rank().over(by_vector)).where(F.col("r") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    one = src.groupBy("key").agg(F.min_by("v", "vec_id").alias("v"))
    entries = ws.stage(one.join(few, "key"), "entries")
    total, longest = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).first()
    shards = max(1, -(-total // shard_rows))
    m = float(longest) ** 0.5
    queries = src.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min_by("v", "key").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # the stated query set meets every shard, in blocks: a task holds one shard and one block
    pts = entries.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ids", "v")
    qs = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    keep = k + SPARE

    def tree(pts: pd.DataFrame, block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pts = pts.iloc[np.argsort([i[0] for i in pts["ids"]], kind="stable")]
        x = np.stack(pts["v"].to_numpy()).astype(np.float64)
        ids = pts["ids"].to_numpy()
        ext = extend(x, m)
        root = build(ext, np.arange(len(x)), np.random.Generator(np.random.PCG64(len(x))), leaf)
        block = block.sort_values("vec_id")
        for lo in range(0, len(block), WALK):
            part = block.iloc[lo : lo + WALK]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            s = Search(ext, np.concatenate([q, np.zeros((len(q), 1))], 1), keep, factor)
            s.walk(root, np.arange(len(q)))
            who, slot = np.nonzero(s.rows >= 0)
            row = s.rows[who, slot]
            score = inner_products(q[who], x[row])
            qid = part["vec_id"].to_numpy()[who]
            n = np.array([len(ids[r]) for r in row])
            out = pd.DataFrame({"query_id": np.repeat(qid, n), "vec_id": np.concatenate([ids[r] for r in row]), "score": np.repeat(score, n)})
            out = out[out.query_id != out.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            yield out.groupby("query_id", sort=False).head(k)

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(tree(left, right), ignore_index=True)

    found = pts.groupBy("shard", "block").cogroup(qs.groupBy("shard", "block")).applyInPandas(both, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
