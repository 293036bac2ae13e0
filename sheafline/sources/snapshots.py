"""The chunk index as snapshots: a full re-index swaps all chunks at once, and readers see the old ones or the new.

A re-index writes chunks and skipped files into folders of its own and then appends one row to a manifest, the only step that
readers notice. A run that fails before it leaves files nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.operators.chunks import DEFAULT_OVERLAP, DEFAULT_SIZE, WORD_SEPARATORS, chunk_pages, clean_pages, documents_without_text

MANIFEST = "version long, snapshot string, chunks long, documents long, skipped long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished re-index; none before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _current(spark: SparkSession, path: str):
    """The newest snapshot: of two that were finished at once the one with the larger name, for all readers alike."""
    return manifest(spark, path).orderBy(F.desc("version"), F.desc("snapshot")).first()


def reindex(pages: DataFrame, path: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP,
            separators: Sequence[str] = WORD_SEPARATORS, refused: DataFrame | None = None) -> str | None:
    """Index ``(document_id, filename, page, text)`` anew and return the name of the snapshot.

    Words are never cut. Documents without any text are skipped, and so are those of ``refused``, a table
    ``(document_id, reject_reason)`` of files that could not be read; both are listed by ``skipped_documents``. Without any
    document nothing is changed and the result is None.
    """
    spark = pages.sparkSession
    kept = clean_pages(pages)
    if refused is not None:
        kept = kept.join(refused.select("document_id").distinct(), "document_id", "left_anti")
    name = uuid.uuid4().hex
    chunk_pages(kept, size, overlap, separators).write.parquet(f"{path}/chunks/{name}")
    reasons = documents_without_text(kept).select("document_id", "reject_reason")
    if refused is not None:
        reasons = reasons.unionByName(refused.select("document_id", "reject_reason").distinct())
    reasons.write.parquet(f"{path}/skipped/{name}")
    made = spark.read.parquet(f"{path}/chunks/{name}")
    chunks, documents = made.agg(F.count("*"), F.count_distinct("document_id")).first()
    skipped = spark.read.parquet(f"{path}/skipped/{name}").count()
    if not chunks and not skipped:
        return None
    last = _current(spark, path)
    row = [((last["version"] if last else 0) + 1, name, chunks, documents, skipped)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return name


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    now = _current(spark, path)
    if now is None:
        raise AnalyticsError("DATASET_NOT_FOUND", "Nothing has been indexed yet.")
    return spark.read.parquet(f"{path}/{part}/{now['snapshot']}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of the newest finished re-index, one snapshot whatever happens meanwhile."""
    return _read(spark, path, "chunks")


def skipped_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(document_id, reject_reason)`` of the newest finished re-index."""
    return _read(spark, path, "skipped")
