"""Binary documents and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import content_hash, safe_filename

# Accepted suffix, first bytes and largest size of a document.
SUFFIX = ".pdf"
FIRST_BYTES = b"%PDF"
MAX_BYTES = 50 * 1024 * 1024


def reject_reason(filename: Column, content: Column) -> Column:
    """Why a document is refused, or NULL."""
    size = F.octet_length(content)
    return (
        F.when(~F.coalesce(F.lower(filename).endswith(SUFFIX), F.lit(False)), "unsupported format")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty document")
        .when(size > MAX_BYTES, "document too large")
        .when(~F.startswith(content, F.lit(FIRST_BYTES)), "invalid header")
    )


def validate_documents(files: DataFrame) -> DataFrame:
    """``(path, filename, size, content_hash, valid, reject_reason)`` of ``(path, content)``."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    reason = reject_reason(name, F.col("content"))
    return files.select(
        "path", safe_filename(name, "document.pdf").alias("filename"), F.octet_length("content").cast("long").alias("size"),
        content_hash(F.col("content")).alias("content_hash"), reason.isNull().alias("valid"), reason.alias("reject_reason"),
    )


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file under ``path`` with its validation. Contents stay inside the scan's tasks.

    Spark's binary source passes over files without a single byte, so those are absent here;
    ``validate_documents`` reports them in tables that come from elsewhere.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return validate_documents(files.select("path", "content"))
