"""Exact top-k search for tables of queries, each with a document of its own to search in if it wants one.

Vectors are dealt to parts of a bounded number of rows and queries to groups, and each part meets each group in a task, so that with as many
queries as vectors neither table is copied once per task. The task holds its vectors as one matrix and streams its queries
past it a batch at a time, in blocks of vectors: a query's k-th score so far rules out what later blocks have below it. What a task hands
on is the best ``k`` of each query, and of those only what reaches the k-th score that a first round over a single part has
found. Nothing but the numbers of vectors and queries comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.numbers import half_even
from sheafline.operators.columns import column, dtype_of
from sheafline.operators.search import DEFAULT_TOP_K, _check, _ranked, _scores
from sheafline.session import written

# Vectors of one part, at most; queries, and vectors, scored together: what one task holds.
PART_ROWS, QUERY_ROWS, BLOCK_ROWS = 50_000, 256, 1024
# Tasks there are at least, unless parts had fewer vectors than a block and groups fewer queries than are scored together.
PARTS = 48
# Scores that agree to this many places are ties, how far a score may be from the rounded one, and how far a cosine worked out in
# single precision from the exact one (at most a rounding of 6e-8 for each of the components and for their sum).
PLACES, MARGIN, SINGLE = 10, 1e-9, 1.2e-7


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; zeros for those without a length."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    units[~np.isfinite(units).all(axis=1)] = 0.0
    return units


def best_rows(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, order: np.ndarray, top_k: int) -> tuple[np.ndarray, ...]:
    """The best ``top_k`` entries of each row, best first, ties by the least ``order`` of the column, and the place of each."""
    placed = np.lexsort((order[cols], -scores, rows))
    rows, cols, scores = rows[placed], cols[placed], scores[placed]
    firsts = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(firsts, np.diff(firsts, append=len(rows)))
    kept = rank < top_k
    return rows[kept], cols[kept], scores[kept], rank[kept]


def best_of(queries: np.ndarray, matrix: np.ndarray, order: np.ndarray, bars: np.ndarray, top_k: int, metric: str,
            scopes: tuple[np.ndarray, np.ndarray] | None = None, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and rounded score of the best ``top_k`` of each query that reach its bar.

    With the cosine both tables hold unit vectors; ``single`` is ``matrix`` in single precision. ``scopes`` are numbers of both tables that have to agree; a query with a negative one
    takes all.
    """
    bars, held = bars.copy(), (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    if metric == "cosine" and single is None:
        single = matrix.astype(np.float32)
    asked, off = queries.astype(np.float32), MARGIN + SINGLE * (queries.shape[1] + 2)
    for at in range(0, len(matrix), BLOCK_ROWS):
        block = matrix[at:at + BLOCK_ROWS]
        if metric == "cosine":
            # Single precision rules out; what is left is scored in double precision.
            reached = asked @ single[at:at + BLOCK_ROWS].T >= (bars - off).astype(np.float32)[:, None]
            some = np.flatnonzero(reached.any(axis=1))
            rows, cols = np.nonzero(reached[some])
            rows = some[rows]
            few = len(rows) * 16 < len(queries) * len(block)
            near = np.einsum("ij,ij->i", queries[rows], block[cols]) if few else (queries @ block.T)[rows, cols]
        else:
            near = _scores(queries, block, metric)
            rows, cols = np.nonzero(near >= (bars - MARGIN)[:, None])
            near = near[rows, cols]
        scores = np.round(near, PLACES)
        reach = (scores >= bars[rows]) & np.isfinite(scores)
        if scopes is not None:
            reach &= (scopes[0][rows] < 0) | (scopes[0][rows] == scopes[1][cols + at])
        if not reach.any():
            continue
        found = rows[reach], cols[reach] + at, scores[reach]
        *held, rank = best_rows(*(np.concatenate(pair) for pair in zip(held, found)), order, top_k)
        last = rank == top_k - 1
        bars[held[0][last]] = held[2][last]
    return tuple(held)


def _run(parts: DataFrame, top_k: int, metric: str) -> DataFrame:
    """``(query_id, vector_id, raw_score)`` of every part: rows of vectors (``kind`` 0) come before those of queries (1)."""
    types = {f.name: f.dataType for f in parts.schema.fields}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, matrix, single, ids, order, scopes = None, [], None, None, None, None, None
        for batch in batches:
            places, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((places[1:] != places[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                run = batch.slice(start, end - start)
                if places[start] != now:
                    now, held, matrix = places[start], [], None
                if kinds[start] == 0:
                    held.append(run)
                    continue
                if not held and matrix is None:
                    continue  # a part without vectors
                if matrix is None:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, matrix, ids = [], _matrix(rows.column("v")), rows.column("vector_id")
                    matrix = _units(matrix) if metric == "cosine" else matrix
                    single = matrix.astype(np.float32) if metric == "cosine" else None
                    order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                    names = rows.column("scope").unique().drop_null()
                    scopes = pc.fill_null(pc.index_in(rows.column("scope"), names), len(names)).to_numpy(zero_copy_only=False)
                for at in range(0, run.num_rows, QUERY_ROWS):
                    asked = run.slice(at, QUERY_ROWS)
                    queries, wanted, limits = _matrix(asked.column("v")), asked.column("scope"), None
                    if wanted.null_count < len(wanted):
                        own = pc.fill_null(pc.index_in(wanted, names), len(names) + 1)
                        limits = pc.if_else(pc.is_null(wanted), -1, own).to_numpy(zero_copy_only=False), scopes
                    r, c, scores = best_of(_units(queries) if metric == "cosine" else queries, matrix, order,
                                           asked.column("bar").to_numpy(zero_copy_only=False), top_k, metric, limits, single)
                    yield pa.RecordBatch.from_arrays(
                        [asked.column("query_id").take(pa.array(r)), ids.take(pa.array(c)), pa.array(scores)], names=["query_id", "vector_id", "raw_score"])

    schema = T.StructType([T.StructField("query_id", types["query_id"]), T.StructField("vector_id", types["vector_id"]),
                           T.StructField("raw_score", T.DoubleType())])
    return parts.mapInArrow(search, schema)


def _grid(n_held: int, n_asked: int, part_rows: int) -> tuple[int, int]:
    """Parts of the vectors and groups of the queries: ``PARTS`` tasks or more where there are rows for them, parts of at most ``part_rows``,
    and few copies of both tables together."""
    least, most = -(-n_held // part_rows), -(-n_held // min(part_rows, BLOCK_ROWS))
    n_parts = max(1, least, min(most, round((PARTS * n_held / max(1, n_asked)) ** 0.5)))
    return n_parts, max(1, min(-(-PARTS // n_parts), -(-n_asked // QUERY_ROWS)))


def search_many(
    vectors: DataFrame,
    queries: DataFrame,
    vector_id: str = "vector_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    document: str | None = None,
    scope: str | None = None,
    top_k: int = DEFAULT_TOP_K,
    min_score: float = 0.0,
    metric: str = "cosine",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``(query_id, rank, vector_id, score)`` of every query, ties by vector id.

    ``scope`` names a column of ``queries`` with the document each wants to search in, NULL for all, and ``document`` the column of
    ``vectors`` that it is compared with. Rows without an id or a vector take no part, and so do queries without hits. All vectors
    have one length. The threshold is applied to the raw score; the score shown is clamped to [0, 1] and rounded to four places.
    """
    _check(top_k, metric)
    within = column(document) if document and scope else F.lit(None)
    wanted = column(scope) if document and scope else F.lit(None)
    kind = dtype_of(vectors, document) if document and scope else T.StringType()
    floats = all(isinstance(getattr(dtype_of(*x), "elementType", None), T.FloatType) for x in ((vectors, vector), (queries, query_vector)))
    numbers = "array<float>" if floats else "array<double>"
    held = vectors.select(
        column(vector_id).alias("vector_id"), column(vector).cast(numbers).alias("v"), within.cast(kind).alias("scope")).where(
        F.col("vector_id").isNotNull() & F.col("v").isNotNull())
    asked = queries.select(
        column(query_id).alias("query_id"), column(query_vector).cast(numbers).alias("v"), wanted.cast(kind).alias("scope")).where(
        F.col("query_id").isNotNull() & F.col("v").isNotNull())
    n_parts, n_groups = _grid(held.count(), asked.count(), part_rows)
    n_cells = n_parts * n_groups
    id_types = dtype_of(queries, query_id), dtype_of(vectors, vector_id)
    placed = held.select(F.pmod(F.xxhash64("vector_id"), F.lit(n_parts)).cast("int").alias("part"), F.lit(0).alias("kind"),
                         F.lit(None).cast(id_types[0]).alias("query_id"), "vector_id", "v", "scope", F.lit(None).cast("double").alias("bar"))

    def each(first: Column | int, n: int, step: int) -> Column:
        """A row for each of ``n`` cells from ``first`` on."""
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k * step + first).cast("int"))).alias("part")

    group = F.pmod(F.xxhash64("query_id"), F.lit(n_groups))
    one = F.pmod(F.xxhash64("query_id"), F.lit(n_cells)).cast("int").alias("part")

    def dealt(rows: DataFrame, questions: DataFrame, part: Column) -> DataFrame:
        asking = questions.select(part, F.lit(1).alias("kind"), "query_id", F.lit(None).cast(id_types[1]).alias("vector_id"), "v", "scope", "bar")
        return rows.unionByName(asking).repartitionById(n_cells, "part").sortWithinPartitions("part", "kind")

    barred = asked.withColumn("bar", F.lit(float(min_score)))
    if n_parts > 1:
        # A first round over one part, each task with a share of the queries: what is below its k-th score is not handed on by the others.
        opening = placed.where(F.col("part") == 0).drop("part").select(each(0, n_cells, 1), "*")
        kth = _ranked(_run(dealt(opening, barred, one), top_k, metric), top_k).where(F.col("rank") == top_k).select(
            "query_id", F.col("raw_score").alias("_kth"))
        known = written(kth, "bars")
        barred = asked.join(known, "query_id", "left").withColumn("bar", F.coalesce("_kth", F.lit(float(min_score)))).drop("_kth")
    copied = placed.withColumn("of", F.col("part") * n_groups).drop("part").select(each(F.col("of"), n_groups, 1), "*").drop("of")
    found = _run(dealt(copied, barred, each(group, n_parts, n_groups)), top_k, metric)
    score = half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_score"))), 4)
    return _ranked(found, top_k).select("query_id", "rank", "vector_id", score.alias("score"))


def with_passages(found: DataFrame, chunks: DataFrame, vector_id: str = "vector_id") -> DataFrame:
    """Hits with the passage each stands for: ``found`` and ``filename, page, text`` of ``chunks``."""
    passages = chunks.select(column(vector_id).alias("vector_id"), "filename", "page", "text")
    return found.join(passages, "vector_id").select(*[F.col(c) for c in found.columns], "filename", "page", "text")
