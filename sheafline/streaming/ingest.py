"""Streaming document ingest with duplicate detection by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafline.functions.text import content_hash
from sheafline.operators.catalog import resolve_duplicates
from sheafline.operators.chunks import DEFAULT_OVERLAP, DEFAULT_SIZE, chunk_pages, clean_pages
from sheafline.session import written

#: Hexadecimal digits of the hash that name a partition of the catalog: 16 partitions. Small batches on a catalog of billions want more.
PREFIX_DIGITS = 1
CATALOG = "document_id long, filename string, content_hash string, size long, prefix string, batch_id long"


def prefix(content_hash: Column) -> Column:
    """The partition of the catalog that a hash belongs to."""
    return F.substring(content_hash, 1, PREFIX_DIGITS)


def open_catalog(spark: SparkSession, catalog_path: str) -> DataFrame:
    """The catalog, made without rows where there is none."""
    spark.createDataFrame([], CATALOG).write.mode("ignore").partitionBy("prefix", "batch_id").parquet(catalog_path)
    return spark.read.schema(CATALOG).parquet(catalog_path)


def ingest_batch(batch: DataFrame, batch_id: int, catalog_path: str, chunks_path: str,
                 size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, resolved_path: str | None = None) -> None:
    """Index the new documents ``(document_id, filename, text)`` of one batch.

    The catalog is partitioned by the first digits of the hash and by batch: a batch reads hashes and ids of the prefixes that occur
    in it only. Every table is partitioned by batch too, and a batch overwrites exactly its own partitions, so a
    batch repeated after a failure leaves the same tables; earlier batches alone count as already indexed.
    Texts are read twice, to be hashed and to be cut, and are not copied. ``resolved_path`` gets ``document_id, content_hash,
    resolved_id, is_duplicate``: which indexed document each one of the batch stands for.
    """
    spark = batch.sparkSession
    hashed = batch.withColumn("content_hash", content_hash(F.col("text")))
    slim = written(hashed.select("document_id", "filename", "content_hash", F.octet_length("text").cast("long").alias("size"),
                                 prefix(F.col("content_hash")).alias("prefix")), "batch")
    met = [r[0] for r in slim.select("prefix").distinct().collect() if r[0] is not None]  # one for each prefix at most
    held = open_catalog(spark, catalog_path).where(F.col("prefix").isin(met) & (F.col("batch_id") < batch_id))
    resolved = written(resolve_duplicates(slim, held.select("content_hash", "document_id")), "resolved")
    # The first document of a content stands for itself, unless an earlier batch has the content under the same id.
    known = held.select("document_id", "content_hash").distinct()
    fresh = resolved.where(~F.col("is_duplicate")).select("document_id", "content_hash").distinct().join(known, ["document_id", "content_hash"], "left_anti")
    fresh = written(fresh, "fresh")

    def write(table: DataFrame, path: str, *parts: str) -> None:
        table.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch_id").parquet(path)

    pages = clean_pages(hashed.join(fresh, ["document_id", "content_hash"], "left_semi").dropDuplicates(["document_id", "content_hash"]).select(
        "document_id", "filename", F.lit(1).alias("page"), "text"))
    write(chunk_pages(pages, size, overlap), chunks_path)
    if resolved_path:
        write(resolved, resolved_path)
    # The catalog comes last: what it names is there. One file per prefix.
    rows = slim.join(fresh, ["document_id", "content_hash"], "left_semi").groupBy("document_id", "content_hash", "size", "prefix").agg(
        F.min("filename").alias("filename"))
    write(rows.select("document_id", "filename", "content_hash", "size", "prefix").repartition("prefix"), catalog_path, "prefix")


def stream_documents(documents: DataFrame, catalog_path: str, chunks_path: str, checkpoint: str, size: int = DEFAULT_SIZE,
                     overlap: int = DEFAULT_OVERLAP, available_now: bool = True, resolved_path: str | None = None) -> StreamingQuery:
    """Start the ingest of a stream of ``(document_id, filename, text)``."""
    def process(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, catalog_path, chunks_path, size, overlap, resolved_path)

    writer = documents.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
