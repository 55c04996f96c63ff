"""Nearest neighbours by inner product: a vantage-point tree in every shard.

Inner products become distances by one more coordinate that gives all vectors the same length.
Rows are dealt to shards by a hash of their id; every shard meets every block of queries, so
a task holds one shard and one block. A leaf is passed over when the triangle inequality, its
bound stretched by ``factor``, puts it beyond the query's k-th neighbour so far: factor 1 is
exact, a larger one skips leaves that could only just hold a neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a shard, queries of a block and rows of a leaf, about.
SHARD, BLOCK, LEAF = 8192, 4096, 256
#: Recall 0.999 on the given embeddings (1: 1.000, 5: 0.994, 6: 0.977, 8: 0.90).
FACTOR = 4.0


@dataclass
class Tree:
    """Points in leaf order; for every leaf its range and the distance bounds to its vantage points."""

    order: np.ndarray
    edges: list[tuple[int, int]]
    vantage: np.ndarray
    bounds: list[list[tuple[int, float, float]]]

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Halves by rank of the distance to the point farthest from the middle; ties split anywhere."""
        order = np.arange(len(points))
        vantage, edges, bounds = [], [], []
        todo = [(0, len(points), [])]
        while todo:
            low, high, above = todo.pop()
            if high - low <= leaf:
                edges.append((low, high))
                bounds.append(above)
                continue
            part = order[low:high]
            some = points[part]
            chosen = some[np.square(some - some.mean(axis=0)).sum(axis=1).argmax()]
            away = np.sqrt(np.square(some - chosen).sum(axis=1))
            ranked = np.argsort(away, kind="stable")
            order[low:high], away = part[ranked], away[ranked]
            half, node = len(part) // 2, len(vantage)
            vantage.append(chosen)
            todo.append((low + half, high, [*above, (node, away[half], away[-1])]))
            todo.append((low, low + half, [*above, (node, away[0], away[half - 1])]))
        return cls(order, edges, np.array(vantage).reshape(len(vantage), points.shape[1]), bounds)

    def least(self, queries: np.ndarray) -> np.ndarray:
        """[query, leaf]: no point of the leaf is nearer than this."""
        square = np.square(queries).sum(axis=1)[:, None] + np.square(self.vantage).sum(axis=1)[None, :]
        away = np.sqrt(np.maximum(square - 2 * queries @ self.vantage.T, 0.0))
        out = np.zeros((len(queries), len(self.edges)))
        for j, above in enumerate(self.bounds):
            for node, low, high in above:
                np.maximum(out[:, j], np.maximum(away[:, node] - high, low - away[:, node]), out=out[:, j])
        return out


def search(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    k: int, scale: float, longest: float, factor: float, leaf: int = LEAF,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query position, id, score) of the k best of each query, best first; products made.

    ``scale`` times the longest vector of the table has length ``longest``. Every turn takes each
    query to its next leaf by bound; leaves rank with fast products, the few that reach the k best
    are multiplied anew, summed alike for equal vectors wherever they are.
    """
    small, asked = vectors * scale, queries * scale
    extra = np.sqrt(np.maximum(longest**2 - np.square(small).sum(axis=1), 0.0))
    tree = Tree.build(np.column_stack([small, extra]), leaf)
    bound = tree.least(np.column_stack([asked, np.zeros(len(asked))])) * factor
    by_bound = np.argsort(bound, axis=1, kind="stable")
    lengths = np.square(asked).sum(axis=1)
    fixed, slack = lengths + longest**2, 1e-9 * longest * np.maximum(np.sqrt(lengths), longest)
    kth = np.full(len(queries), -np.inf)  # of scaled products
    at, names, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    made = 0
    for turn in range(len(tree.edges)):
        leaf_of = by_bound[:, turn]
        limit = np.sqrt(np.maximum(fixed - 2 * kth, 0.0))
        active = np.flatnonzero(bound[np.arange(len(leaf_of)), leaf_of] <= limit + slack)
        if not len(active):
            break
        parts = [(at, names, scores)]
        for j in np.unique(leaf_of[active]):
            of = active[leaf_of[active] == j]
            rows = tree.order[slice(*tree.edges[j])]
            made += len(of) * len(rows)
            rough = asked[of] @ small[rows].T
            rough[query_ids[of][:, None] == ids[rows][None, :]] = -np.inf
            least = kth[of]
            if len(rows) > k:
                least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
            q, c = np.nonzero((rough >= (least - slack[of])[:, None]) & (rough > -np.inf))
            parts.append((of[q], ids[rows[c]], (queries[of[q]] * vectors[rows[c]]).sum(axis=1)))
        at, names, scores = (np.concatenate(p) for p in zip(*parts, strict=True))
        ranked = np.lexsort((names, -scores, at))
        at, names, scores = at[ranked], names[ranked], scores[ranked]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == k - 1
        kth[at[last]] = scores[last] * scale * scale
        keep = rank < k
        at, names, scores = at[keep], names[keep], scores[keep]
    return at, names, scores, made


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not null or zero, without null or non-finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    df: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query.

    Queries are the rows where ``is_query`` (over ``id_col``) holds; candidates are all rows but
    the query's own. Ties go to the smaller id. Vectors that are null, zero or hold null or
    non-finite components take no part; vectors of another length are never compared. Repeated
    rows of an id count once (of several vectors the least). Null ids take no part. An empty
    table gives an empty result. Ids are whole numbers; extra columns are not read.
    """
    rows = (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asked"))
        .where(F.col("vec_id").isNotNull() & usable("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"), F.max(F.coalesce("asked", F.lit(False))).alias("asked"))
        .withColumn("dim", F.size("v"))
    )
    most = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("int")).alias("q"), F.max(most).alias("most"), F.max("dim").alias("dim")).first()
    scale = 1.0 / (facts.most or 1.0)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * scale * x * scale))
    longest = rows.agg(F.max(length)).first()[0] or 1.0
    shards, blocks = -(-(facts.n or 1) // SHARD), -(-(facts.q or 1) // BLOCK)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(shards)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.lit(blocks)).cast("int"))
    every = rows.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    asked = rows.where("asked").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return schema.empty_table()
        ids, query_ids = (t.column("vec_id").to_numpy() for t in (shard, block))
        vectors, queries = (
            t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (shard, block)
        )
        at, names, scores, _ = search(ids, vectors, query_ids, queries, k, scale, longest, factor)
        return pa.table({"query_id": query_ids[at], "vec_id": names, "score": scores}, schema=schema)

    keys = ["dim", "shard", "block"]
    found = every.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
