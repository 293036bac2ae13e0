"""Exact search against a full scan."""

import math
import random

import numpy as np

from sheafline.llm import topk


def plain(rows, queries, k, scale=256):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    held = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    asked = {}
    for i, v in queries:
        if i is not None and whole(v) is not None:
            asked[i] = min(asked.get(i, whole(v)), whole(v))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=7):
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    asked = vectors.where(f"vec_id % {every} = 0")
    got = sorted(map(tuple, topk.search(vectors, asked, k).collect()))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain(exact, [(i, v) for i, v in exact if i is not None and i % every == 0], k)


def test_matches_a_full_scan_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(topk, "LEAF", 16)
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in rnd.choice(centres)]) for i in range(900)]
    check(spark, rows)


def test_ties_repeats_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "LEAF", 8)
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randint(-1, 1)) for _ in range(4)]) for i in range(160)] + [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(200, 320)]
    rows += [(7, [0.5, 0.5, 0.5, 0.5]), (7, [0.25, 0.0, 0.0, 0.0]), (21, None), (28, [None, 1.0, 1.0, 1.0]), (35, [float("nan"), 0.0, 0.0, 0.0]),
             (42, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (49, [1.0, 2.0]), (50, [3.0, 4.0]), (56, []), (150, [1.0, 1.0, 0.0, 0.0])]
    check(spark, rows)


def test_fewer_candidates_than_asked_for_and_empty_tables(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 0.0])])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, empty).count() == 0
