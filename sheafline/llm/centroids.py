"""Centroid clustering with a progressive search over Walsh-Hadamard coefficients.

Vectors are whole numbers and so are their transforms, whose squared differences add up to the squared distance times the number of
coefficients. A vector's differences to all centroids are added up coarse to fine, a block of coefficients at a time; the centroid
that leads after the first block is taken to the end at once, and every centroid whose sum is already strictly above that distance
is dropped. Those left are summed over all coefficients, so the nearest centroid and its distance are exact and ties go to the
smaller number. A round is one scan: tasks send a sum per centroid, and only the centroids pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import stored

# Coefficients of one step of the search, and vectors searched together.
STEP, ROWS = 8, 4_096
# Components up to this size keep every sum in a 64-bit integer.
LARGEST = 1 << 24


def transform(vectors: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows of whole numbers (zeros added up to a power of two), coarse coefficients first:
    those of fewer sign changes."""
    n = 1 << max(0, vectors.shape[1] - 1).bit_length()
    out = np.zeros((len(vectors), n), dtype=np.int64)
    out[:, :vectors.shape[1]] = vectors
    half = 1
    while half < n:
        pairs = out.reshape(len(out), n // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        half *= 2
    return out[:, coarse_to_fine(n)]


def coarse_to_fine(n: int) -> np.ndarray:
    """The coefficients of a transform of size ``n`` by the sign changes of their row of the matrix."""
    matrix = np.ones((1, 1), dtype=np.int64)
    while len(matrix) < n:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return np.argsort((matrix[:, 1:] != matrix[:, :-1]).sum(axis=1), kind="stable")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector and the squared distance, and how many coefficients were compared.

    ``centroids`` and ``vectors`` are transforms.
    """
    n, k = vectors.shape[1], len(centroids)
    step = min(STEP, n)
    sums = ((vectors[:, None, :step] - centroids[None, :, :step]) ** 2).sum(axis=2)
    lead = sums.argmin(axis=1)
    least = ((vectors - centroids[lead]) ** 2).sum(axis=1)
    who, which = np.nonzero(sums <= least[:, None])
    sums, compared = sums[who, which], len(vectors) * k * step
    for at in range(step, n, step):
        sums += ((vectors[who, at:at + step] - centroids[which, at:at + step]) ** 2).sum(axis=1)
        compared += len(who) * step
        left = sums <= least[who]
        who, which, sums = who[left], which[left], sums[left]
    # Each vector's leader is among those left, centroids ascending.
    firsts = np.flatnonzero(np.diff(who, prepend=-1))
    best = np.minimum.reduceat(sums, firsts) if len(firsts) else sums
    hits = np.flatnonzero(sums == np.repeat(best, np.diff(firsts, append=len(who))))
    _, first_hit = np.unique(who[hits], return_index=True)
    return which[hits[first_hit]], best // n, compared


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v`` of the vectors of ``dims`` finite components: ``floor(scale * x)`` of each as bigint."""
    fit = (F.size(vector_column) == dims) & F.forall(
        vector_column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = vectors.where(F.col(vector_column).isNotNull() & fit)
    return held.select(F.col(id_column).cast("long").alias("vec_id"),
                       F.transform(vector_column, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(rows: pa.Array, dims: int) -> np.ndarray:
    values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    if len(values) and (values.max() > LARGEST or values.min() < -LARGEST):
        raise ValueError(f"a component is beyond {LARGEST} in size after scaling, so distances might not fit a bigint")
    return values


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least hash of seed and id; ties of repeated ids go to the smaller vector."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = whole.orderBy(F.sha2(text.cast("binary"), 256), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floored mean of the vectors nearest to each, unchanged where there are none."""
    k, dims = centroids.shape
    known = transform(centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _matrix(batch.column(0).slice(at, ROWS), dims)
                which, _, _ = nearest(transform(rows), known)
                np.add.at(sums, which, rows)
                counts += np.bincount(which, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = whole.select("v").mapInArrow(add_up, "cluster long, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums"))
    out = centroids.copy()
    for row in totals.collect():  # at most k rows
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dims, known = centroids.shape[1], transform(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                which, distance, _ = nearest(transform(_matrix(part.column(1), dims)), known)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(which.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return whole.mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256,
            id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Clusters of the vectors of ``dims`` finite components, and the final centroids.

    The table has ``vec_id, cluster, distance`` (squared), ``cluster_inertia`` and ``inertia`` (distances added up over the cluster
    and over all). ``k`` bounds what passes through the driver: ``k`` centroids a round. Vectors that are null, of another length, or
    hold a null or a component that is not finite take no part. A null id stays null and is hashed as the empty text; repeated rows
    are vectors each; of fewer than ``k`` vectors each is a centroid; an empty table gives no rows and no centroids; other columns
    are not looked at, whatever their names. Components beyond 2^24 after scaling are refused with ``ValueError`` in the job.
    """
    whole = whole_vectors(vectors, dims, scale, id_column, vector_column)
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        nothing = whole.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))))
        return nothing.where("false"), centroids.reshape(0, dims)
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    held = stored(assigned(whole, centroids), "clusters")
    inertias = [tuple(r) for r in held.groupBy("cluster").agg(F.sum("distance")).collect()]  # at most k rows
    per_cluster = vectors.sparkSession.createDataFrame(
        [(c, d, sum(d for _, d in inertias)) for c, d in inertias], "cluster int, cluster_inertia long, inertia long")
    return held.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def digests(centroids: np.ndarray) -> list[str]:
    """The SHA-256 of each centroid's components, as decimal numbers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
