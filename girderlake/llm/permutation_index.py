"""Nearest neighbours by a permutation index: pivot orders, pivot inverted files, footrule distance, exact rerank.

A vector is represented by its ``prefix`` nearest pivots in order. Rows are dealt to shards by a hash of their id and
queries to blocks likewise, so a task holds one shard and one block whatever the data look like. In a shard every
pivot has an inverted file: the vectors that have it in their prefix, with its place. A query reads the files of its
own pivots and adds up how far each vector's order is from its own; the nearest orders are reranked on the original
vectors. Of each shard a query keeps its ``k`` best, which meet once more by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from girderlake.llm.store import cut

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 4096, 4096


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components, not all zero, of the most common length.

    Rows without id take no part; rows that share an id count as one, with the least of their vectors.
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & whole)
    one = good.groupBy("id").agg(F.min("v").alias("v"))
    usual = one.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).agg(F.max_by("n", F.struct("rows", -F.col("n"))).alias("usual"))
    return one.join(F.broadcast(usual), F.size("v") == F.col("usual")).select("id", "v")


def choose_pivots(vectors: DataFrame, pivots: int, sample: int = 8) -> np.ndarray:
    """``pivots`` vectors that lie far from each other, of ``sample`` times as many whose ids hash lowest.

    The sample is bounded and doesn't depend on partitions. Each next pivot is the one farthest from all before it, so
    near copies in the sample don't take several places.
    """
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample * pivots).collect()
    some = np.array([r["v"] for r in rows], np.float64)
    if len(some) <= pivots:
        return some
    chosen, far = [0], np.full(len(some), np.inf)
    while len(chosen) < pivots:
        far = np.minimum(far, ((some - some[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return some[chosen]


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector, nearest first; ties to the pivot of smaller number."""
    far = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class InvertedFiles:
    """For each pivot the vectors that have it in their prefix, and its place in each."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.prefix = orders.shape
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.at = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.row, self.place = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int32)
        self.n = n

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of every vector's order from the query's; a pivot outside a prefix stands at its end.

        A pivot at places i and j brings its two sides 2 * (prefix - max(i, j)) nearer than if it were in one only.
        """
        out = np.full(self.n, self.prefix * (self.prefix + 1), np.int32)
        for i, pivot in enumerate(query.tolist()):
            a, b = self.at[pivot], self.at[pivot + 1]
            out[self.row[a:b]] -= 2 * (self.prefix - np.maximum(self.place[a:b], i))
        return out


def search_shard(ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, q_orders: np.ndarray, pivots: int, k: int, share: float, least: int, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance): of this shard the ``k`` nearest found of each query.

    Reranked are the ``share`` of the shard whose orders are nearest (``least`` of them at least), and besides every
    vector within ``near`` of the greatest footrule distance: of near copies none is left to chance.
    """
    files = InvertedFiles(orders, pivots)
    most = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
    within = near * files.prefix * (files.prefix + 1)
    out: tuple[list, list, list] = ([], [], [])
    for q, v, order in zip(q_ids.tolist(), q_vectors, q_orders):
        far = files.footrule(order)
        edge = max(np.partition(far, most - 1)[most - 1], within) if most < len(ids) else far.max()
        found = np.flatnonzero((far <= edge) & (ids != q))
        distance = np.sqrt(((vectors[found] - v) ** 2).sum(1))
        if len(found) > 4 * k:
            some = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
            found, distance = found[some], distance[some]
        best = np.lexsort((ids[found], distance))[:k]
        out[0].append(np.full(len(best), q))
        out[1].append(ids[found[best]])
        out[2].append(distance[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, np.float64)))


def nearest(table: DataFrame, queries: str, k: int = 10, pivots: int = 128, prefix: int = 32, share: float = 0.2, least: int = 1024, near: float = 0.3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean distance), nearest first.

    queries: SQL condition on ``id`` that says which rows are queries; candidates are all other rows. Ties go to the
    smaller id. With fewer candidates than ``k`` all are returned; an empty table, or one without usable vectors, gives
    no rows (see ``usable`` for which take part). ``share`` trades time for recall.
    """
    vectors = cut(usable(table, id_col, vector_col))
    counts = vectors.agg(F.count("*").alias("n"), F.count_if(F.expr(queries)).alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // SHARD)), max(1, -(-counts["q"] // BLOCK))
    centres = choose_pivots(vectors, pivots)
    prefix = min(prefix, len(centres))

    def order(batches):
        for batch in batches:
            v = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            orders = pivot_orders(v, centres, prefix)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(orders), pa.list_(pa.int32()))], names=["id", "v", "pivots"])

    indexed = vectors.mapInArrow(order, "id long, v array<double>, pivots array<int>")
    left = indexed.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = indexed.where(queries).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        made = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if own.num_rows and asked.num_rows:
            side = []
            for t in (own, asked):
                t = t.combine_chunks()
                side += [t["id"].to_numpy(), *(t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for c in ("v", "pivots"))]
            made = search_shard(*side, len(centres), k, share, least, near)
        return pa.table([pa.array(x) for x in made], names=["query_id", "vec_id", "score"])

    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
