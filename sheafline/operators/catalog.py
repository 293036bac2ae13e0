"""Document catalog: content hashes, duplicate detection, metadata, look-up, listing, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import content_hash
from sheafline.operators.skew import lookup_by_key
from sheafline.session import cut_lineage


def with_hash(documents: DataFrame, content: str = "content") -> DataFrame:
    return documents.withColumn("content_hash", content_hash(F.col(content)))


def first_by_hash(documents: DataFrame, order: str) -> DataFrame:
    """``(content_hash, document_id, copies)``: the first document of each content.

    A partial aggregate: a million copies of one text leave each task as one row.
    """
    # A plain minimum aggregates by hash; a minimum by another column has to sort.
    first = F.min("document_id") if order == "document_id" else F.min_by("document_id", F.struct(order, "document_id"))
    return documents.groupBy("content_hash").agg(first.alias("document_id"), F.count(F.lit(1)).alias("copies"))


def documents_without_content(documents: DataFrame) -> DataFrame:
    """Documents whose content is NULL, so that nothing can be compared: ``(document_id, reject_reason)``."""
    return documents.filter(F.col("content_hash").isNull()).select("document_id", F.lit("no content").alias("reject_reason"))


def resolve_duplicates(incoming: DataFrame, indexed: DataFrame | None = None, order: str = "document_id") -> DataFrame:
    """Which document each incoming one resolves to: ``(document_id, content_hash,
    resolved_id, is_duplicate)``.

    ``incoming`` has ``document_id``, ``content_hash`` and the ``order`` column; ``indexed`` is the
    catalog so far. Content that is already indexed resolves to the indexed document, whatever its
    file name; otherwise the first of the batch wins. Documents without content are no duplicates of anything and are left to
    ``documents_without_content``. Texts are read once: ids and hashes are
    checkpointed, and everything else works on those.
    """
    slim = cut_lineage(incoming.filter(F.col("content_hash").isNotNull()).select("document_id", "content_hash", *([order] if order != "document_id" else [])))
    known = first_by_hash(slim, order)
    if indexed is not None:
        old = indexed.groupBy("content_hash").agg(F.min("document_id").alias("_known"))
        known = known.join(old, "content_hash", "left").withColumn("document_id", F.coalesce("_known", "document_id"))
    firsts = known.select("content_hash", F.col("document_id").alias("resolved_id"), "copies")
    resolved = lookup_by_key(slim, firsts, "content_hash", "copies", "resolved_id", F.col("document_id"))
    return resolved.select(
        "document_id", "content_hash", "resolved_id", (F.col("document_id") != F.col("resolved_id")).alias("is_duplicate")
    )


def new_documents(incoming: DataFrame, indexed: DataFrame, order: str = "document_id") -> DataFrame:
    """The documents to index: the first of each content that the catalog does not hold; none without content."""
    slim = incoming.filter(F.col("content_hash").isNotNull()).select("document_id", "content_hash", *([order] if order != "document_id" else []))
    firsts = first_by_hash(slim, order)
    # Distinct first: copies of one content in the catalog would meet in one task.
    known = indexed.select("content_hash").distinct()
    fresh = firsts.join(known, "content_hash", "left_anti").select("document_id")
    return incoming.join(fresh, "document_id", "left_semi")


def document_metadata(documents: DataFrame, pages: DataFrame, chunks: DataFrame, uploaded_at: Column) -> DataFrame:
    """``(document_id, filename, size, content_hash, page_count, chunk_count, status, uploaded_at)``.

    ``documents`` has ``document_id, filename, size, content_hash``. A document without chunks is
    not indexed and does not appear.
    """
    per_document = pages.groupBy("document_id").agg(F.count_distinct("page").alias("page_count"))
    chunked = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return (
        documents.join(per_document, "document_id").join(chunked, "document_id")
        .select("document_id", "filename", "size", "content_hash", "page_count", "chunk_count",
                F.lit("indexed").alias("status"), uploaded_at.alias("uploaded_at"))
    )


def find_document(catalog: DataFrame, id_or_name: str) -> DataFrame:
    """The document with that id, else the first one (by id) with that file name; at most one row."""
    by_id = F.col("document_id").cast("string") == F.lit(str(id_or_name))
    by_name = F.col("filename") == F.lit(str(id_or_name))
    return catalog.filter(by_id | by_name).orderBy(by_id.desc(), "document_id").limit(1)


def list_documents(catalog: DataFrame) -> DataFrame:
    """Newest first, with the display columns of a document list."""
    listed = catalog.select(
        "*", F.col("document_id").alias("id"), F.col("filename").alias("name"), F.lit("application/pdf").alias("type")
    )
    return listed.orderBy(F.desc("uploaded_at"), "document_id")


def without_document(table: DataFrame, catalog: DataFrame, id_or_name: str) -> DataFrame:
    """``table`` (chunks or the catalog itself) without one document's rows; others are untouched.

    The id is a one-row subquery of the catalog; when nothing matches, everything stays.
    """
    target = find_document(catalog, id_or_name).select("document_id").scalar()
    return table.filter(~F.col("document_id").eqNullSafe(target))
