import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.functions.splitting import split_text
from sheafline.operators import catalog, chunks, search, skew

PAGES = "document_id long, filename string, page int, text string"


def indexed(df):
    return [(r["document_id"], r["page"], r["chunk_index"], r["chunk_id"]) for r in df.orderBy("document_id", "chunk_index").collect()]


def test_chunks_are_numbered_across_pages(frame):
    phrase = "policy text " * 50
    df = frame([(1, "a.pdf", 2, phrase), (1, "a.pdf", 1, phrase), (1, "a.pdf", 3, ""), (2, "b.pdf", 1, "One sentence.")], PAGES)
    rows = chunks.chunk_pages(df, 300, 50).orderBy("document_id", "chunk_index").collect()
    first = [r for r in rows if r["document_id"] == 1]
    assert len(first) > 2 and [r["chunk_index"] for r in first] == list(range(len(first)))
    assert [r["page"] for r in first] == sorted(r["page"] for r in first) and {r["page"] for r in first} == {1, 2}
    assert rows[-1]["chunk_id"] == "2:0" and rows[-1]["filename"] == "b.pdf" and rows[-1]["text"] == "One sentence."
    assert all(len(r["text"]) <= 300 for r in rows)


def test_blocks_of_pages_number_like_one_block(frame, monkeypatch):
    rng = random.Random(4)
    rows = [(d, "f.pdf", p, "w " * rng.randrange(0, 120)) for d in (1, 2) for p in range(1, 60 if d == 1 else 4)]
    df = frame(rows, PAGES).repartition(3)
    whole = indexed(chunks.chunk_pages(df, 60, 10))
    monkeypatch.setattr(chunks, "PAGES_PER_BLOCK", 5)
    assert indexed(chunks.chunk_pages(df, 60, 10)) == whole
    assert indexed(chunks.chunk_fixed(df, 60, 10)) != []


def test_fixed_windows(frame):
    df = frame([(1, "f", 1, "abcdefghij"), (2, "f", 1, "abc"), (3, "f", 1, ""), (4, "f", 1, None), (5, "f", 1, "ab" + " " * 9)], PAGES)
    rows = [(r["document_id"], r["text"]) for r in chunks.chunk_fixed(df, 4, 1).orderBy("document_id", "chunk_index").collect()]
    assert rows == [(1, "abcd"), (1, "defg"), (1, "ghij"), (2, "abc"), (5, "ab  ")]


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, 10), (10, -1)])
def test_windows_must_make_progress(frame, size, overlap):
    with pytest.raises(AnalyticsError, match="INVALID_CHUNKING"):
        chunks.chunk_pages(frame([], PAGES), size, overlap)


def test_documents_without_text(frame):
    df = frame([(1, "f", 1, " \n"), (1, "f", 2, None), (2, "f", 1, ""), (2, "f", 2, "x")], PAGES)
    assert [tuple(r) for r in chunks.documents_without_text(df).collect()] == [(1, 2, "no extractable text")]


def docs(frame, rows):
    return catalog.with_hash(frame(rows, "document_id long, filename string, content string"))


def test_duplicates_resolve_to_the_first_document(frame):
    batch = docs(frame, [(3, "c.pdf", "same"), (1, "a.pdf", "same"), (2, "b.pdf", "other"), (4, "d.pdf", "old")])
    old = docs(frame, [(0, "z.pdf", "old")])
    rows = {r["document_id"]: (r["resolved_id"], r["is_duplicate"]) for r in catalog.resolve_duplicates(batch, old).collect()}
    assert rows == {1: (1, False), 3: (1, True), 2: (2, False), 4: (0, True)}
    assert sorted(r["document_id"] for r in catalog.new_documents(batch, old).collect()) == [1, 2]


def test_lookup_spreads_heavy_keys(frame, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_KEYS", 1)
    batch = docs(frame, [(i, "f", "hot" if i % 3 else f"t{i % 9}") for i in range(300)])
    rows = catalog.resolve_duplicates(batch).collect()
    assert len(rows) == 300
    assert {r["resolved_id"] for r in rows} == {0, 1, 3, 6}


def test_catalog(frame):
    pages = frame([(1, "a.pdf", 1, "one two"), (1, "a.pdf", 2, "three"), (2, "b.pdf", 1, "four"), (3, "c.pdf", 1, "")], PAGES)
    split = chunks.chunk_pages(pages)
    described = frame([(1, "a.pdf", 10, "h1"), (2, "b.pdf", 20, "h2"), (3, "c.pdf", 30, "h3")],
                      "document_id long, filename string, size long, content_hash string")
    held = catalog.document_metadata(described, pages, split, F.concat(F.lit("2024-0"), "document_id"))
    rows = [(r["document_id"], r["page_count"], r["chunk_count"], r["status"], r["name"], r["id"]) for r in catalog.list_documents(held).collect()]
    assert rows == [(2, 1, 1, "indexed", "b.pdf", 2), (1, 2, 2, "indexed", "a.pdf", 1)]
    assert catalog.find_document(held, "b.pdf").first()["document_id"] == 2
    assert catalog.find_document(held, "1").first()["filename"] == "a.pdf"
    assert catalog.find_document(held, "nope").count() == 0
    left = catalog.without_document(split, held, "a.pdf")
    assert [r["document_id"] for r in left.collect()] == [2]
    assert catalog.without_document(split, held, "nope").count() == split.count()


@pytest.fixture
def vectors(frame):
    rng = np.random.default_rng(5)
    points = rng.standard_normal((300, 16))
    points[10] = points[20]
    rows = [(i, [float(x) for x in p], i % 3) for i, p in enumerate(points)]
    return frame(rows, "vector_id long, embedding array<float>, document_id int").repartition(5)


def brute(vectors, queries, k, metric, floor=0.0):
    held = {r["vector_id"]: np.array(r["embedding"], dtype=float) for r in vectors.collect()}
    found = {}
    for q in queries.collect():
        v = np.array(q["embedding"], dtype=float)
        score = {i: (v @ w) / np.linalg.norm(v) / np.linalg.norm(w) if metric == "cosine" else 1 - ((v - w) ** 2).sum() / np.sqrt(2)
                 for i, w in held.items()}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
        found[q["query_id"]] = [(i, round(min(1.0, max(0.0, score[i])), 4)) for i in best if score[i] >= floor]
    return found


def as_map(hits):
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vector_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


@pytest.fixture
def queries(vectors):
    return vectors.filter("vector_id < 7").select(F.col("vector_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("metric", search.METRICS)
@pytest.mark.parametrize("per_pass", [1024, 3])
def test_search_matches_brute_force(vectors, queries, monkeypatch, metric, per_pass):
    monkeypatch.setattr(search, "QUERIES_PER_PASS", per_pass)
    assert as_map(search.search_topk(vectors, queries, top_k=10, metric=metric)) == brute(vectors, queries, 10, metric)


def test_search_inside_a_document_and_above_a_score(vectors, queries):
    inside = vectors.filter("document_id = 1")
    found = as_map(search.search_topk(inside, queries, top_k=50, min_score=0.2))
    expected = {q: hits for q, hits in brute(inside, queries, 50, "cosine", 0.2).items() if hits}
    assert found == expected
    assert search.search_topk(inside.limit(0), queries).count() == 0


def test_search_refusals(vectors, queries):
    for k in (0, 51):
        with pytest.raises(AnalyticsError, match="INVALID_TOP_K"):
            search.search_topk(vectors, queries, top_k=k)
    with pytest.raises(AnalyticsError, match="EMPTY_QUERY"):
        search.search_topk(vectors, queries.limit(0))
    with pytest.raises(AnalyticsError, match="INVALID_METRIC"):
        search.search_topk(vectors, queries, metric="manhattan")


def test_approximate_search(vectors, queries):
    exact = search.search_topk(vectors, queries, top_k=5)
    close = search.search_approximate(vectors, queries, top_k=5)
    row = search.recall(exact, close).first()
    assert row["expected"] == 35 and row["recall"] >= 0.9
    met = search.approximate_candidates(vectors, queries)
    assert met.count() < 0.6 * vectors.count() * queries.count() and met.distinct().count() == met.count()
    every = search.search_approximate(vectors, queries, top_k=5, tables=1, bits=3, probes=8)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    assert search.search_approximate(vectors, queries.limit(0)).count() == 0


def test_probes_go_from_near_to_far_and_reach_every_bucket():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        v = rnd.standard_normal(8)
        order = search.probed_buckets(v, 2, 4, 3, 16)
        for t in range(2):
            mine = [b for table, b in order if table == t]
            assert sorted(mine) == list(range(16)) and mine[0] == search._codes(v[None, :], 2, 4, 3)[0, t]


def test_buckets(vectors):
    held = search.with_buckets(vectors, tables=4, bits=3).filter("vector_id in (10, 20)").collect()
    assert held[0]["buckets"] == held[1]["buckets"] and len(held[0]["buckets"]) == 4 and max(held[0]["buckets"]) < 8


def test_vector_expressions(vectors):
    one = vectors.filter("vector_id = 3").select(search._pair_score(F.col("embedding"), F.col("embedding"), "cosine")).first()[0]
    assert one == pytest.approx(1.0)


def test_citations_and_context(frame):
    hits = frame([(1, 2, "b.pdf", 4, "two"), (1, 1, "a.pdf", 1, "one"), (1, 3, "a.pdf", 1, "three"), (1, 4, "c.pdf", 9, "four"), (2, 1, "c.pdf", 2, "x")],
                 "query_id int, rank int, filename string, page int, text string")
    cited = {r["query_id"]: r["citations"] for r in search.citations(hits).collect()}
    assert cited == {1: ["a.pdf (Page 1)", "b.pdf (Page 4)", "c.pdf (Page 9)"], 2: ["c.pdf (Page 2)"]}
    row = search.context(hits).filter("query_id = 1").first()
    assert row["context"] == "[Source: a.pdf (Page 1)]\none\n\n---\n\n[Source: b.pdf (Page 4)]\ntwo\n\n---\n\n[Source: a.pdf (Page 1)]\nthree"
    assert row["sources"] == ["a.pdf (Page 1)", "b.pdf (Page 4)"]


def test_pages_without_number_or_document_keep_their_chunks(frame):
    pages = frame([("a", "f", 1, "one"), ("a", "f", None, "two"), (None, "f", 2, "three"), (None, "f", None, "four"), ("a", "f", 9000, "five"),
                   ("a", "f", 9000, "six"), ("b", "f", 1, ""), ("b", "f", 2, None)],
                  "document_id string, filename string, page int, text string").repartition(3)
    for made in (chunks.chunk_pages(pages), chunks.chunk_fixed(pages)):
        rows = made.collect()
        assert sorted(r["text"] for r in rows) == ["five", "four", "one", "six", "three", "two"]
        assert sorted((r["chunk_index"], r["text"] in ("five", "six")) for r in rows if r["document_id"] == "a") == [
            (0, False), (1, False), (2, True), (3, True)]
        assert sorted(r["chunk_index"] for r in rows if r["document_id"] is None) == [0, 1]


def test_documents_without_content_are_no_duplicates(frame):
    rows = frame([(1, None), (2, None), (3, "h"), (4, "h"), (5, "k")], "document_id long, content_hash string")
    assert sorted(map(tuple, catalog.resolve_duplicates(rows).collect())) == [(3, "h", 3, False), (4, "h", 3, True), (5, "k", 5, False)]
    indexed = frame([(9, "k"), (8, None)], "document_id long, content_hash string")
    assert [r["document_id"] for r in catalog.new_documents(rows, indexed).collect()] == [3]
    assert sorted(r["document_id"] for r in catalog.documents_without_content(rows).collect()) == [1, 2]


def test_pages_of_one_batch_are_split_in_slices(frame):
    lengths = [0, 5, chunks.SPLIT_AT_ONCE, 3, 4, 3 * chunks.SPLIT_AT_ONCE, 1]
    cuts = list(chunks._slices(lengths))
    assert [x for start, end in cuts for x in range(start, end)] == list(range(len(lengths))) and len(cuts) > 3
    assert all(end - start == 1 or sum(lengths[start:end]) <= chunks.SPLIT_AT_ONCE for start, end in cuts)
    assert list(chunks._slices([])) == []
    texts = [None, "", *(f"p{i} " * 60_000 for i in range(12)), "last"]
    df = frame([(i, None, i, t) for i, t in enumerate(texts)], PAGES).coalesce(1)
    made = {}
    for r in chunks.chunk_pages(df).orderBy("document_id", "chunk_index").collect():
        made.setdefault(r["document_id"], []).append(r["text"])
    assert made == {i: split_text(t, 1000, 200) for i, t in enumerate(texts) if t}


def test_vectors_and_queries_of_one_batch_are_hashed_in_slices():
    rng = np.random.default_rng(7)
    batch = pd.Series([None if i % 9 == 4 else v for i, v in enumerate(rng.standard_normal((1500, 8)))])
    parts = list(search.coded(batch, 4, 3, 1))
    assert len(parts) > 1 and max(map(len, parts)) <= search.CODED_AT_ONCE
    for v, found in zip(batch, pd.concat(parts)):
        assert found is None if v is None else found.tolist() == search._codes(v[None, :], 4, 3, 1)[0].tolist()
    asked = batch.dropna().iloc[:40]
    parts = list(search.probed(asked, 2, 4, 3, 5))
    assert len(parts) > 1 and max(map(len, parts)) <= search.PROBED_AT_ONCE
    assert [[(p["t"], p["b"]) for p in row] for row in pd.concat(parts)] == [search.probed_buckets(v, 2, 4, 3, 5) for v in asked]
