"""Full re-indexes: the newest finished one is read, whole."""

import pytest
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.operators import chunks
from sheafline.sources import snapshots

PAGES = "document_id long, filename string, page int, text string"


def shown(spark, path):
    held = sorted((r["document_id"], r["page"], r["text"]) for r in snapshots.read_index(spark, path).collect())
    return held, sorted((r["document_id"], r["reject_reason"]) for r in snapshots.skipped_documents(spark, path).collect())


def test_a_reindex_swaps_everything_and_a_failed_one_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(AnalyticsError, match="DATASET_NOT_FOUND"):
        snapshots.read_index(spark, path)
    first = frame([(1, "a", 1, "alpha"), (1, "a", 2, "beta"), (2, "b", 1, "  "), (3, "c", 1, "gamma " * 400), (4, "d", 1, "delta")], PAGES)
    refused = frame([(4, "invalid header"), (9, "document too large")], "document_id long, reject_reason string")
    snapshots.reindex(first, path, refused=refused)
    once = shown(spark, path)
    assert {d for d, _, _ in once[0]} == {1, 3} and once[1] == [(2, "no extractable text"), (4, "invalid header"), (9, "document too large")]

    broken = first.withColumn("text", F.when(F.col("document_id") == 3, F.raise_error(F.lit("unreadable")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="unreadable"):
        snapshots.reindex(broken, path)
    assert shown(spark, path) == once

    reader = snapshots.read_index(spark, path)  # opened before the swap
    fewer = first.where("document_id = 1")
    snapshots.reindex(fewer, path)
    assert shown(spark, path) == ([(1, 1, "alpha"), (1, 2, "beta")], [])
    assert reader.select("document_id").distinct().count() == 2
    assert snapshots.reindex(first.where("false"), path) is None and shown(spark, path)[0] == [(1, 1, "alpha"), (1, 2, "beta")]
    assert [r["version"] for r in snapshots.manifest(spark, path).orderBy("version").collect()] == [1, 2]


def test_words_stay_whole(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    pages = frame([(1, "a", 1, "word " * 30 + "x" * 90)], PAGES)
    snapshots.reindex(pages, path, size=40, overlap=5)
    want = chunks.chunk_pages(pages, 40, 5, chunks.WORD_SEPARATORS).select("text").collect()
    assert sorted(r["text"] for r in snapshots.read_index(spark, path).collect()) == sorted(r["text"] for r in want)
