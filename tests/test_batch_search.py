"""Searches for tables of queries against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sheafline.errors import AnalyticsError
from sheafline.operators import batch_search, search


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (300, 8)).astype(float)  # few values: many ties
    vectors[40:80] = vectors[40]
    vectors[5] = 0.0
    queries = np.vstack([vectors[::6], rng.standard_normal((30, 8))])
    rows = [(f"v{i:03d}", v.tolist(), f"doc{i % 7}", i % 3, f"text {i}") for i, v in enumerate(vectors)]
    asked = [(i, q.tolist(), [None, "doc2", "doc5", "nowhere"][i % 4]) for i, q in enumerate(queries)]
    return rows, asked, spark.createDataFrame(rows, "vector_id string, embedding array<float>, filename string, page int, text string").repartition(3), spark.createDataFrame(
        asked, "query_id long, embedding array<double>, scope string").repartition(2)


def brute(rows, asked, top_k, metric, least, scoped):
    matrix = np.array([r[1] for r in rows])
    out = {}
    for i, q, scope in asked:
        scores = np.round(search._scores(np.array([q]), matrix, metric)[0], batch_search.PLACES)
        held = sorted((-s, r[0]) for s, r in zip(scores, rows) if s >= least and (not scoped or scope is None or r[2] == scope))
        out.update({(i, n + 1): (v, round(min(1.0, max(0.0, -s)), 4)) for n, (s, v) in enumerate(held[:top_k])})
    return out


@pytest.mark.parametrize("metric, part_rows, scoped, least", [
    ("cosine", 1000, False, 0.0), ("cosine", 37, True, 0.0), ("l2_relevance", 60, True, -1e9), ("cosine", 25, False, 0.3), ("cosine", 3, True, 0.0)])
def test_every_query_finds_its_best(tables, monkeypatch, metric, part_rows, scoped, least):
    monkeypatch.setattr(batch_search, "QUERY_ROWS", 17)
    rows, asked, vectors, queries = tables
    names = {"document": "filename", "scope": "scope"} if scoped else {}
    found = batch_search.search_many(vectors, queries, top_k=6, metric=metric, part_rows=part_rows, min_score=least, **names)
    got = {(r["query_id"], r["rank"]): (r["vector_id"], r["score"]) for r in found.collect()}
    want = brute(rows, asked, 6, metric, least, scoped)
    assert got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_later_parts_hand_on_what_reaches_the_first_rounds_score(tables, monkeypatch):
    rows, asked, vectors, queries = tables
    handed = []
    real = batch_search._run
    monkeypatch.setattr(batch_search, "_run", lambda *a: handed.append(real(*a)) or handed[-1])
    batch_search.search_many(vectors, queries, top_k=5, part_rows=25).collect()
    opening = {}
    for r in handed[0].collect():
        opening.setdefault(r["query_id"], []).append(r["raw_score"])
    kth = {q: sorted(scores)[-5] for q, scores in opening.items() if len(scores) >= 5}
    assert len(handed) == 2 and len(kth) > 60
    assert all(r["raw_score"] >= kth[r["query_id"]] for r in handed[1].collect() if r["query_id"] in kth)


def test_passages_nulls_and_nothing(spark, tables):
    _, _, vectors, queries = tables
    found = batch_search.search_many(vectors, queries.limit(3), top_k=2)
    shown = batch_search.with_passages(found, vectors).collect()
    assert shown and all(r["text"] == f"text {int(r['vector_id'][1:])}" and r["filename"].startswith("doc") for r in shown)
    odd = vectors.withColumn("embedding", F.when(F.col("page") > 0, F.col("embedding")))
    none = queries.withColumn("embedding", F.when(F.col("query_id") > 3, F.col("embedding")))
    assert {r["query_id"] for r in batch_search.search_many(odd, none, top_k=1, min_score=-1.0).collect()} == set(range(4, 80))
    assert batch_search.search_many(vectors.where("false"), queries).count() == 0
    assert batch_search.search_many(vectors, queries.where("false")).count() == 0
    with pytest.raises(AnalyticsError, match="INVALID_TOP_K"):
        batch_search.search_many(vectors, queries, top_k=0)


def test_vectors_beyond_a_block_are_dealt_to_several_tasks_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((5000, 6)).round(1)
    rows = [(i, v.tolist(), f"doc{i % 3}", i, "") for i, v in enumerate(vectors)]
    asked = [(i, vectors[i].tolist(), [None, "doc1"][i % 2]) for i in range(0, 5000, 250)]
    held = spark.createDataFrame(rows, "vector_id long, embedding array<float>, filename string, page int, text string")
    handed = []
    real = batch_search._run
    monkeypatch.setattr(batch_search, "_run", lambda parts, *a: handed.append(parts.rdd.getNumPartitions()) or real(parts, *a))
    found = batch_search.search_many(held, spark.createDataFrame(asked, "query_id long, embedding array<double>, scope string"),
                                     document="filename", scope="scope", min_score=0.2, top_k=4)
    exact = [(i, np.array(v, dtype=np.float32).astype(float).tolist(), d, p, t) for i, v, d, p, t in rows]
    want = brute(exact, asked, 4, "cosine", 0.2, True)
    got = {(r["query_id"], r["rank"]): r["vector_id"] for r in found.collect()}
    assert got == {k: v[0] for k, v in want.items()}
    assert handed == [5, 5]  # the first round, too, has its queries shared out


def test_memory_of_a_block_does_not_grow_with_the_vectors(monkeypatch):
    rng = np.random.default_rng(2)
    queries, matrix = (batch_search._units(rng.standard_normal((n, 4))) for n in (20, 6000))
    shapes, real = [], np.nonzero
    monkeypatch.setattr(batch_search.np, "nonzero", lambda m: shapes.append(m.shape) or real(m))
    rows, cols, scores = batch_search.best_of(queries, matrix, np.arange(6000), np.full(20, -np.inf), 3, "cosine")
    assert max(shape[1] for shape in shapes if len(shape) == 2) <= batch_search.BLOCK_ROWS
    plain = np.round(queries @ matrix.T, batch_search.PLACES)
    assert all(cols[rows == q].tolist() == np.lexsort((np.arange(6000), -plain[q]))[:3].tolist() for q in range(20))


def test_registered_searches_ask_with_every_vector(spark, tmp_path):
    rng = np.random.default_rng(11)
    vectors = rng.integers(-2, 3, (150, 8)).astype(float)
    ids = [3 * i + 1 + i % 2 for i in range(150)]  # few of them divisible by 100
    labels = [i % 4 for i in range(150)]
    spark.createDataFrame([(v, m.tolist(), lab) for v, m, lab in zip(ids, vectors, labels)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(v, f"text {v}", "s", v) for v in ids], "doc_id long, text string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    rows = [(v, m.tolist(), lab) for v, m, lab in zip(ids, vectors, labels)]
    want = brute(rows, [(v, m, lab if v % 3 == 0 else None) for v, m, lab in rows], 5, "cosine", 0.2, True)
    found = __spark_entry__.queries()["search_many"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["rank"]): r["vector_id"] for r in found} == {k: v[0] for k, v in want.items()}
    shown = __spark_entry__.queries()["search_passages"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["rank"]): r["text"] for r in shown} == {k: f"text {v[0]}" for k, v in want.items()}
    assert len({r["query_id"] for r in found}) == 150


def test_as_many_queries_as_vectors_are_dealt_in_groups():
    for held, asked in ((51_282, 51_282), (615_384, 615_384), (10**7, 10**7), (10**6, 10**4), (300, 10**6)):
        parts, groups = batch_search._grid(held, asked, batch_search.PART_ROWS)
        assert -(-held // parts) <= batch_search.PART_ROWS and parts * groups >= batch_search.PARTS
        # Copies of both tables: far fewer than one of every query per task, unless parts are as large as they may be.
        assert held * groups + asked * parts <= 20 * max(held, asked) or parts <= -(-held // batch_search.PART_ROWS)
    assert batch_search._grid(5000, 20, batch_search.PART_ROWS) == (5, 1) and batch_search._grid(0, 0, 10) == (1, 1)


def test_blocks_of_queries_in_several_groups_find_the_best(spark, tables, monkeypatch):
    monkeypatch.setattr(batch_search, "QUERY_ROWS", 10)
    monkeypatch.setattr(batch_search, "BLOCK_ROWS", 64)
    rows, asked, vectors, queries = tables
    cells, real = [], batch_search._run
    monkeypatch.setattr(batch_search, "_run", lambda parts, *a: cells.append(parts.rdd.getNumPartitions()) or real(parts, *a))
    found = batch_search.search_many(vectors, queries, top_k=6, document="filename", scope="scope")
    assert {(r["query_id"], r["rank"]): r["vector_id"] for r in found.collect()} == {
        k: v[0] for k, v in brute(rows, asked, 6, "cosine", 0.0, True).items()}
    assert cells == [40, 40]  # five parts, eight groups
