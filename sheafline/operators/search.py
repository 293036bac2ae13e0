"""Top-k vector search, exact and by hashing, with citations and context.

Vectors are never paired with each other and never shuffled. Each task scores its Arrow batches
against the (few) queries with one matrix product, keeps the best ``k`` per query, and only those
meet in a final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.errors import AnalyticsError, check_range
from sheafline.functions.numbers import half_even
from sheafline.operators.columns import column, dtype_of
from sheafline.session import scratch_path

MAX_TOP_K = 50
DEFAULT_TOP_K = 5
# Queries scored per pass over the vectors; more queries take more passes.
QUERIES_PER_PASS = 1024
METRICS = ("cosine", "l2_relevance")
CANDIDATES_SALT = 64
# Vectors, and queries with all their probes, that a task works out at a time, however many a batch holds.
CODED_AT_ONCE, PROBED_AT_ONCE = 512, 16
# Hash tables, planes of each, buckets probed in each, and the seed of the planes.
TABLES, BITS, PROBES, SEED = 24, 12, 64, 17


def dot_product(a: Column, b: Column) -> Column:
    """Dot product of two ARRAY<FLOAT> columns in built-in functions, for use in filters."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _check(top_k: int, metric: str) -> None:
    check_range(top_k, 1, MAX_TOP_K, "INVALID_TOP_K", "top_k")
    if metric not in METRICS:
        raise AnalyticsError("INVALID_METRIC", f"Unknown metric {metric!r}; use one of {METRICS}.")


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Score of every (query, vector) of one batch."""
    query_norms, vector_norms = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1)
    dots = queries @ vectors.T
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(dots / np.outer(query_norms, vector_norms), nan=0.0)
    squared = np.maximum(query_norms[:, None] ** 2 + vector_norms[None, :] ** 2 - 2 * dots, 0.0)
    return 1.0 - squared / np.sqrt(2.0)


def _best(scores: np.ndarray, ids: np.ndarray, top_k: int) -> np.ndarray:
    """Positions of the best ``top_k``, ties by id."""
    if len(scores) > top_k:
        floor = np.partition(scores, -top_k)[-top_k]
        positions = np.flatnonzero(scores >= floor)
    else:
        positions = np.arange(len(scores))
    return positions[np.lexsort((ids[positions], -scores[positions]))][:top_k]


def _hyperplanes(dimensions: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dimensions))


def _codes(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """One bucket number per table: which side of each of its random planes a vector lies on."""
    sides = (vectors @ _hyperplanes(vectors.shape[1], tables, bits, seed).T) >= 0
    return sides.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits))


def _query_passes(queries: DataFrame, query_id: str, vector: str):
    """The queries in passes of a bounded number of rows, streamed to the driver one at a time."""
    held: list = []
    rows = queries.select(column(query_id).alias("q"), column(vector).alias("v")).filter(F.col("v").isNotNull())
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == QUERIES_PER_PASS:
            yield [r["q"] for r in held], _matrix([r["v"] for r in held])
            held = []
    if held:
        yield [r["q"] for r in held], _matrix([r["v"] for r in held])


def _candidates(vectors: DataFrame, query_ids: list, query_matrix: np.ndarray, vector_id: str, vector: str,
                id_types: tuple[T.DataType, T.DataType], top_k: int, metric: str) -> DataFrame:
    """Best ``top_k`` per query of each task: ``(query_id, vector_id, raw_score)``."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.empty:
                continue
            ids, matrix = batch["id"].to_numpy(), _matrix(batch["v"])
            scores = _scores(query_matrix, matrix, metric)
            for q in range(len(query_ids)):
                line, known = scores[q], ids
                if q in best:
                    line, known = np.concatenate([best[q][0], line]), np.concatenate([best[q][1], known])
                keep = _best(line, known, top_k)
                best[q] = line[keep], known[keep]
        for q, (line, known) in best.items():
            if len(line):
                yield pd.DataFrame({"query_id": [query_ids[q]] * len(line), "vector_id": known, "raw_score": line})

    schema = T.StructType([
        T.StructField("query_id", id_types[0]), T.StructField("vector_id", id_types[1]), T.StructField("raw_score", T.DoubleType()),
    ])
    slim = vectors.select(column(vector_id).alias("id"), column(vector).alias("v")).filter(F.col("v").isNotNull())
    return slim.mapInPandas(score, schema)


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    """Rank 1..k per query. Candidates of one query are first thinned in parallel slices."""
    order = [F.desc("raw_score"), F.asc("vector_id")]
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("vector_id"), F.lit(CANDIDATES_SALT)))
    thinned = sliced.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_slice").orderBy(*order)))
    thinned = thinned.filter(F.col("_r") <= top_k)
    ranked = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top_k).drop("_slice", "_r")


def _search(vectors: DataFrame, queries: DataFrame, vector_id: str, vector: str, query_id: str, query_vector: str,
            top_k: int, min_score: float, metric: str) -> DataFrame:
    _check(top_k, metric)
    id_types = dtype_of(queries, query_id), dtype_of(vectors, vector_id)
    passes = _query_passes(queries, query_id, query_vector)
    held = next(passes, None)
    if held is None:
        raise AnalyticsError("EMPTY_QUERY", "There is no query vector to search with.")
    following, stored = next(passes, None), None
    while True:
        found = _candidates(vectors, *held, vector_id, vector, id_types, top_k, metric)
        if following is None and stored is None:
            break
        # Many queries: each pass is finished and written before the next queries are read, so
        # the driver never holds more than two passes of them.
        stored = stored or scratch_path(vectors.sparkSession, "search")
        _ranked(found, top_k).drop("rank").write.mode("append").parquet(stored)
        if following is None:
            found = vectors.sparkSession.read.parquet(stored)
            break
        held, following = following, next(passes, None)
    found = found.filter(F.col("raw_score") >= min_score)
    score = half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_score"))), 4)
    return _ranked(found, top_k).select("query_id", "rank", "vector_id", score.alias("score"))


def search_topk(
    vectors: DataFrame,
    queries: DataFrame,
    vector_id: str = "vector_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    top_k: int = DEFAULT_TOP_K,
    min_score: float = 0.0,
    metric: str = "cosine",
) -> DataFrame:
    """Exact search: ``(query_id, rank, vector_id, score)``, ties by vector id.

    The threshold is applied to the raw score; the score shown is clamped to [0, 1] and rounded to
    four places. To restrict a search to a document, filter ``vectors`` first: the filter reaches
    the scan. Queries are read in passes of 1,024.
    """
    return _search(vectors, queries, vector_id, vector, query_id, query_vector, top_k, min_score, metric)


def _slim(df: DataFrame, id_name: str, vector: str) -> DataFrame:
    return df.select(column(id_name).alias("id"), column(vector).alias("v")).filter(F.col("v").isNotNull())


def coded(batch: pd.Series, tables: int, bits: int, seed: int) -> Iterator[pd.Series]:
    """The buckets of a batch's vectors, some rows at a time."""
    for at in range(0, len(batch), CODED_AT_ONCE):
        values = batch.iloc[at:at + CODED_AT_ONCE]
        present = values.dropna()
        found = pd.Series([None] * len(values), index=values.index, dtype=object)
        if len(present):
            found[present.index] = list(_codes(_matrix(present), tables, bits, seed).astype("int32"))
        yield found


def with_buckets(vectors: DataFrame, vector: str = "embedding", tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """``vectors`` with ``buckets ARRAY<INT>``: the bucket in each table, to store an index by them."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield from coded(batch, tables, bits, seed)

    return vectors.withColumn("buckets", codes(column(vector)))


def probed_buckets(vector: np.ndarray, tables: int, bits: int, seed: int, probes: int) -> list[tuple[int, int]]:
    """``(table, bucket)`` of the ``probes`` buckets of each table that lie nearest to a vector: those reached by crossing the
    planes with the least sum of squared distances."""
    distance = (_hyperplanes(len(vector), tables, bits, seed) @ vector).reshape(tables, bits)
    crossed = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    own = (distance >= 0) @ (1 << np.arange(bits))
    cost = distance**2 @ crossed.T
    nearest = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return [(t, int(own[t]) ^ int(x)) for t in range(tables) for x in nearest[t]]


def probed(batch: pd.Series, tables: int, bits: int, seed: int, probes: int) -> Iterator[pd.Series]:
    """The probed buckets of a batch's queries, few queries at a time."""
    for at in range(0, len(batch), PROBED_AT_ONCE):
        yield batch.iloc[at:at + PROBED_AT_ONCE].map(
            lambda v: [{"t": t, "b": b} for t, b in probed_buckets(np.asarray(v, dtype=np.float64), tables, bits, seed, probes)])


def approximate_candidates(vectors: DataFrame, queries: DataFrame, vector_id: str = "vector_id", vector: str = "embedding",
                           query_id: str = "query_id", query_vector: str = "embedding", tables: int = TABLES, bits: int = BITS,
                           probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """Distinct ``(query_id, vector_id)`` that meet in a bucket: the pairs that ``search_approximate`` scores.

    Every vector is indexed in every table. Buckets are joined on ``(table, bucket)``; a bucket that holds a third of the
    vectors is met by the queries that probe it, never by other vectors.
    """

    @F.pandas_udf("array<struct<t:int,b:int>>")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield from probed(batch, tables, bits, seed, probes)

    asked = _slim(queries, query_id, query_vector).select(F.col("id").alias("query_id"), F.explode(probe("v")).alias("p")).select(
        "query_id", F.col("p.t").alias("t"), F.col("p.b").alias("b"))
    index = with_buckets(_slim(vectors, vector_id, vector), "v", tables, bits, seed).select(
        F.col("id").alias("vector_id"), F.posexplode("buckets").alias("t", "b"))
    return asked.join(index, ["t", "b"]).select("query_id", "vector_id").distinct()


def _pair_score(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        length = F.sqrt(dot_product(a, a) * dot_product(b, b))
        return F.when(length == 0, 0.0).otherwise(dot_product(a, b) / length)
    apart = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0))
    return 1.0 - F.aggregate(apart, F.lit(0.0), lambda total, x: total + x) / F.sqrt(F.lit(2.0))


def search_approximate(
    vectors: DataFrame,
    queries: DataFrame,
    vector_id: str = "vector_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    top_k: int = DEFAULT_TOP_K,
    min_score: float = 0.0,
    metric: str = "cosine",
    tables: int = TABLES,
    bits: int = BITS,
    probes: int = PROBES,
    seed: int = SEED,
) -> DataFrame:
    """Search by random-hyperplane hashing: only vectors in a bucket that a query probes are scored.

    Same columns as ``search_topk``. More ``probes`` or ``tables`` find more and score more.
    """
    _check(top_k, metric)
    pairs = approximate_candidates(vectors, queries, vector_id, vector, query_id, query_vector, tables, bits, probes, seed)
    held = _slim(vectors, vector_id, vector).select(F.col("id").alias("vector_id"), F.col("v").alias("_v"))
    asked = _slim(queries, query_id, query_vector).select(F.col("id").alias("query_id"), F.col("v").alias("_q"))
    scored = pairs.join(held, "vector_id").join(asked, "query_id").select(
        "query_id", "vector_id", _pair_score(F.col("_q"), F.col("_v"), metric).alias("raw_score"))
    score = half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_score"))), 4)
    return _ranked(scored.filter(F.col("raw_score") >= min_score), top_k).select("query_id", "rank", "vector_id", score.alias("score"))


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row ``(expected, found, recall)`` of an approximate result against the exact one."""
    hits = approximate.select("query_id", "vector_id", F.lit(1).alias("hit"))
    joined = exact.select("query_id", "vector_id").join(hits, ["query_id", "vector_id"], "left")
    counted = joined.agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"))
    return counted.withColumn("recall", F.col("found") / F.col("expected"))


def citation(filename: Column, page: Column) -> Column:
    """``file (Page n)``."""
    return F.concat(filename, F.lit(" (Page "), page.cast("string"), F.lit(")"))


def _in_rank_order(text: Column) -> Column:
    """Texts of a query's hits in rank order: at most ``MAX_TOP_K`` of them."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda h: h["t"])


def citations(hits: DataFrame) -> DataFrame:
    """``(query_id, citations)``: distinct, in order of first appearance."""
    cited = _in_rank_order(citation(F.col("filename"), F.col("page")))
    return hits.groupBy("query_id").agg(F.array_distinct(cited).alias("citations"))


def context(hits: DataFrame, top_k: int = 3) -> DataFrame:
    """``(query_id, context, sources)``: the best passages as labelled blocks in rank order."""
    best = hits.filter(F.col("rank") <= top_k)
    label = citation(F.col("filename"), F.col("page"))
    block = F.concat(F.lit("[Source: "), label, F.lit("]\n"), F.col("text"))
    return best.groupBy("query_id").agg(
        F.array_join(_in_rank_order(block), "\n\n---\n\n").alias("context"),
        F.array_distinct(_in_rank_order(label)).alias("sources"),
    )
