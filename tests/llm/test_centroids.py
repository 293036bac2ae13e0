"""Clusters against plain rounds, and the progressive search against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from sheafline.llm import centroids


def plain(rows, k, rounds, seed, dims, scale):
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(held, key=key)[:k]]

    def assign():
        out = []
        for i, v in held:
            distances = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, distances.index(min(distances)), min(distances)))
        return out

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, c, _) in zip(held, assign()):
            groups.setdefault(c, []).append(v)
        for c, members in groups.items():
            centres[c] = [sum(x) // len(members) for x in zip(*members)]
    last = assign()
    inertia = {}
    for _, c, d in last:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(((i, c, d, inertia[c], sum(inertia.values())) for i, c, d in last), key=repr), centres


def check(spark, rows, **options):
    options = {"k": 6, "rounds": 3, "seed": 2, "dims": 8, "scale": 256} | options
    vectors = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, `a.b` string").repartition(3)
    found, final = centroids.cluster(vectors, **options)
    want, centres = plain(rows, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert final.tolist() == centres
    assert centroids.digests(final) == [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]


def blobs(rnd, n, dims):
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 64])
def test_the_transform_is_that_of_the_matrix_and_keeps_distances(n):
    matrix = np.ones((1, 1), dtype=np.int64)
    while len(matrix) < n:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    rows = np.random.default_rng(1).integers(-500, 500, (20, n))
    order = centroids.coarse_to_fine(n)
    assert (centroids.transform(rows) == (rows @ matrix)[:, order]).all()
    changes = [(np.diff(matrix[i]) != 0).sum() for i in order]
    assert changes == list(range(n))
    moved = centroids.transform(rows)
    assert (((moved[0] - moved[1:]) ** 2).sum(axis=1) == n * ((rows[0] - rows[1:]) ** 2).sum(axis=1)).all()


def test_search_finds_the_nearest_with_ties_and_compares_less():
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (40, 64))
    centres[7] = centres[3]
    rows = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64))
    which, distance, compared = centroids.nearest(centroids.transform(rows), centroids.transform(centres))
    full = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (which == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert compared < rows.size * 40 / 3
    small = rng.integers(-1, 2, (500, 64))  # many ties
    which, distance, _ = centroids.nearest(centroids.transform(small), centroids.transform(np.zeros((4, 64), dtype=np.int64)))
    assert (which == 0).all() and (distance == (small**2).sum(axis=1)).all()


def test_clusters_match_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 50)
    rnd = random.Random(1)
    check(spark, blobs(rnd, 400, 8))
    check(spark, blobs(rnd, 200, 64), k=40, rounds=5, dims=64)
    check(spark, blobs(rnd, 150, 5), dims=5)  # no power of two


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randint(-1, 1)) for _ in range(8)]) for i in range(60)] + [(i, [1.0] * 8) for i in range(100, 140)]
    rows += [(7, [0.5] * 8), (7, [0.25] * 8), (7, [0.25] * 8), (None, [0.1] * 8), (None, [0.2] * 8), (201, None), (202, [None] + [1.0] * 7),
             (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7), (205, [1.0]), (206, []), (207, [1.0] * 9)]
    check(spark, rows)
    check(spark, rows, k=12, rounds=1)


def test_fewer_vectors_than_centroids_and_an_empty_table(spark):
    check(spark, [(1, [0.0] * 8), (2, [1.0] * 8), (3, [1.0] * 8)])
    found, final = centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"] and found.count() == 0 and len(final) == 0


def test_components_that_would_not_fit_are_refused(spark):
    vectors = spark.createDataFrame([(1, [1e9] * 8), (2, [0.0] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 16777216"):
        centroids.cluster(vectors, dims=8)[0].count()
