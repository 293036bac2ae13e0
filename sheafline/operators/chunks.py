"""Pages of text to overlapping chunks with document-wide numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.errors import AnalyticsError
from sheafline.functions.splitting import SEPARATORS, split_text
from sheafline.functions.text import clean_text, trim_blank
from sheafline.session import written

DEFAULT_SIZE = 1000
DEFAULT_OVERLAP = 200
# Separators of the older full re-index, which never cuts inside a word.
WORD_SEPARATORS = SEPARATORS[:-1]
# Characters of pages whose chunks are held in Python at a time; a longer page is split by itself.
SPLIT_AT_ONCE = 1 << 20
# Page numbers of one document that are summed in one task.
PAGES_PER_BLOCK = 4096


def _check_window(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise AnalyticsError("INVALID_CHUNKING", f"Need size >= 1 and 0 <= overlap < size, got {size} and {overlap}.")


def clean_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with cleaned text."""
    return pages.withColumn("text", F.coalesce(clean_text(F.col("text")), F.lit("")))


def documents_without_text(pages: DataFrame) -> DataFrame:
    """Documents none of whose pages has any text: ``(document_id, page_count, reject_reason)``."""
    length = F.max(F.coalesce(F.length(trim_blank(F.col("text"))), F.lit(0)))
    per_document = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), length.alias("longest"))
    return per_document.filter(F.col("longest") == 0).select(
        "document_id", "page_count", F.lit("no extractable text").alias("reject_reason")
    )


def _numbered(pages_with_chunks: DataFrame) -> DataFrame:
    """One row per chunk with its document-wide index.

    Pages are written once with a row number of their own. Numbering works on ``(document, page, number of chunks)`` alone: totals per
    block of pages first, then running totals inside a block, so no task holds a whole document. The start comes back to
    each page by its row number, a key that no two rows share. Pages without a number come first; rows without a
    document id are numbered together.
    """
    held = written(pages_with_chunks.withColumn("_row", F.monotonically_increasing_id()), "pages")
    block = F.floor(F.col("page") / PAGES_PER_BLOCK)
    counted = held.select("document_id", "page", "_row", block.alias("_block"), F.size("chunks").alias("_n"))
    blocks = counted.groupBy("document_id", "_block").agg(F.sum("_n").alias("_block_n"))
    before = (Window.unboundedPreceding, -1)
    across = Window.partitionBy("document_id").orderBy("_block").rowsBetween(*before)
    starts = blocks.select(
        F.col("document_id").alias("_d"), F.col("_block").alias("_b"), F.coalesce(F.sum("_block_n").over(across), F.lit(0)).alias("_block_start")
    )
    inside = Window.partitionBy("document_id", "_block").orderBy("page", "_row").rowsBetween(*before)
    placed = counted.withColumn("_in_block", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        starts, F.col("document_id").eqNullSafe(F.col("_d")) & F.col("_block").eqNullSafe(F.col("_b"))
    ).select("_row", (F.col("_block_start") + F.col("_in_block")).alias("_start"))
    rows = held.join(placed, "_row").select("document_id", "filename", "page", "_start", F.posexplode("chunks").alias("pos", "text"))
    index = (F.col("_start") + F.col("pos")).cast("long")
    return rows.select(
        F.concat_ws(":", F.col("document_id").cast("string"), index.cast("string")).alias("chunk_id"),
        index.alias("chunk_index"), "document_id", "filename", "page", "text",
    )


def _slices(lengths: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Start and end of runs of pages of up to ``SPLIT_AT_ONCE`` characters together; one page at least."""
    start = held = 0
    for end, length in enumerate(lengths):
        if end > start and held + length > SPLIT_AT_ONCE:
            yield start, end
            start, held = end, 0
        held += length
    if start < len(lengths):
        yield start, len(lengths)


def chunk_pages(
    pages: DataFrame,
    size: int = DEFAULT_SIZE,
    overlap: int = DEFAULT_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> DataFrame:
    """Split ``(document_id, filename, page, text)`` into
    ``(chunk_id, chunk_index, document_id, filename, page, text)``.

    Chunks never cross pages; blank ones are dropped.
    """
    _check_window(size, overlap)
    chosen = tuple(separators)
    slim = pages.select("document_id", "filename", "page", "text")
    schema = T.StructType([*slim.schema.fields[:3], T.StructField("chunks", T.ArrayType(T.StringType()))])

    def split_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for start, end in _slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                made = [split_text(t, size, overlap, chosen) if t else [] for t in texts.slice(start, end - start).to_pylist()]
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in range(3)), pa.array(made, pa.list_(texts.type))], names=schema.names)

    return _numbered(slim.mapInArrow(split_pages, schema))


def chunk_fixed(pages: DataFrame, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """The same table with plain character windows, entirely in built-in functions."""
    _check_window(size, overlap)
    length, step = F.length("text"), size - overlap
    # A window starts at every step until one reaches the end of the text.
    last = F.greatest(F.lit(0), F.ceil((length - size) / F.lit(step))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("text"), i * step + 1, F.lit(size)))
    present = F.filter(
        F.when(length > 0, windows).otherwise(F.array().cast("array<string>")),
        lambda c: F.length(trim_blank(c)) > 0,
    )
    with_chunks = pages.select("document_id", "filename", "page", present.alias("chunks"))
    return _numbered(with_chunks)
