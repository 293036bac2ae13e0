"""Exact search by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id; a shard's task builds a ball tree of numpy arrays. A block of queries
walks the tree together: a node's bound for a query is ``q . centre + |q| * radius``, nodes are opened in the order of their
best bound, and a query leaves a node whose bound is below its current k-th score. That score is shared in two ways: within a
task over all its nodes and, before the full search, through a first round in which every query searches one shard and the
k-th score found there becomes its starting bound everywhere. Scores are whole numbers and computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.common import stored

LEAF = 128
# Rows of one shard, and queries of one block: what one task holds.
SHARD_ROWS, BLOCK_QUERIES = 4_096, 2_048


def whole_vectors(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v``: components ``floor(scale * x)`` as bigint; rows without an id, a vector, or a finite number in
    each component take no part."""
    x = F.transform(vector_column, lambda c: c.cast("double"))
    finite = F.forall(vector_column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite)
    return held.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class BallTree:
    """Nodes in arrays; rows reordered so that a node is a range."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.order = rows, np.arange(len(rows))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._build()

    def _build(self) -> None:
        waiting = [(0, len(self.rows), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            part = self.rows[self.order[start:end]]
            centre = part.mean(axis=0)
            away = ((part - centre) ** 2).sum(axis=1)
            me = len(self.nodes)
            self.nodes.append([start, end, centre, float(np.sqrt(away.max())), -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = me
            if end - start > LEAF and away.max() > 0:
                one = part[away.argmax()]
                other = part[((part - one) ** 2).sum(axis=1).argmax()]
                middle = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(part @ (other - one), middle)]
                waiting += [(start, start + middle, me, 0), (start + middle, end, me, 1)]
        self.rows = self.rows[self.order]


def search_shard(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray):
    """Best ``k`` rows of a shard for each query as arrays (query position, id, score), rows whose id is the query's own
    left out. ``least`` holds the k-th scores known so far: rows below it are not returned."""
    ids = ids[tree.order]
    scores = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), -1, dtype=np.int64)
    length = np.sqrt((queries**2).sum(axis=1))
    bar = least.astype(np.float64).copy()
    waiting = [(0, np.arange(len(queries)), None)]
    while waiting:
        at, who, bound = waiting.pop()
        start, end, _, _, left, right = tree.nodes[at]
        if bound is not None:
            who = who[bound >= bar[who]]  # the bar may have risen since the node was put off
            if not len(who):
                continue
        if left < 0:
            dots = queries[who] @ tree.rows[start:end].T
            dots[query_ids[who][:, None] == ids[start:end][None, :]] = -np.inf
            better = (dots >= bar[who][:, None]).any(axis=1)
            who, dots = who[better], dots[better]
            if not len(who):
                continue
            all_scores = np.concatenate([scores[who], dots], axis=1)
            all_ids = np.concatenate([found[who], np.broadcast_to(ids[start:end], dots.shape)], axis=1)
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[who], found[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
            bar[who] = np.maximum(bar[who], scores[who, -1])
            continue
        children = []
        for child in (left, right):
            centre, radius = tree.nodes[child][2], tree.nodes[child][3]
            bounds = queries[who] @ centre + length[who] * radius
            bounds += 1e-9 * (np.abs(bounds) + length[who] * (np.sqrt(centre @ centre) + radius)) + 1e-6  # rounding never hides a row
            keep = bounds >= bar[who]
            if keep.any():
                children.append((bounds[keep].max(), child, who[keep], bounds[keep]))
        children.sort(key=lambda c: (c[0], c[1]))
        waiting += [c[1:] for c in children]  # the better one is taken up first
    position, column = np.nonzero((scores > -np.inf) & (scores >= least[:, None]))
    return position, found[position, column], scores[position, column]


def _search(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: best rows of each shard for the queries sent to it (columns ``shard, block, least``)."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
        ids, sizes = held["vec_id"].to_numpy(np.int64), held["v"].map(len).to_numpy()
        for size, group in asked.groupby(asked["v"].map(len)):
            same = np.nonzero(sizes == size)[0]
            if not len(same):
                continue
            rows, q = (np.array(x.tolist(), dtype=np.float64).reshape(len(x), size) for x in (held["v"].iloc[same], group["v"]))
            own = group["query_id"].to_numpy(np.int64)
            at, who, scores = search_shard(BallTree(rows), ids[same], q, own, k, group["least"].to_numpy(np.float64))
            parts.append(pd.DataFrame({"query_id": own[at], "vec_id": who, "score": scores.astype(np.int64)}))
        return pd.concat(parts)

    blocks = queries.groupBy(F.col("shard").alias("at"), F.col("block").alias("for")).count()
    blocks = blocks.select(F.col("at").alias("shard"), F.col("for").alias("block"))
    held = shards.join(F.broadcast(blocks), "shard")  # at most shards x blocks rows of two numbers
    return held.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest whole-number inner product for each row of ``queries``:
    ``query_id, rank, vec_id, score``, ties to the smaller id.

    A query is never its own answer (rows with its id are left out). Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part. Repeated rows of ``vectors`` each count; queries that
    repeat an id are asked once, with the smallest of their vectors. Vectors of another length than the query's are not compared. With fewer
    than ``k`` candidates all are returned; empty tables give no rows. Scores are exact below 2^53 in size.
    """
    rows = stored(whole_vectors(vectors, scale, id_column, vector_column), "vectors")
    asked = whole_vectors(queries, scale, id_column, vector_column).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked.withColumnRenamed("vec_id", "query_id"), "queries")
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    n_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(n_shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(n_blocks)).cast("int"))
    nothing = F.lit(float("-inf"))
    first = asked.select("query_id", "v", "block", (F.col("block") % n_shards).alias("shard"), nothing.alias("least"))
    bars = _search(shards, first, k).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("score").cast("double").alias("bar")).where(F.col("n") >= k).select("query_id", "bar")
    everywhere = asked.join(bars, "query_id", "left").select(
        "query_id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.coalesce("bar", nothing).alias("least"))
    return _best(_search(shards, everywhere, k), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
