"""What the operators on documents share: input columns, scratch tables, readable folds."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.session import scratch_path


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the whole text of every row, a null text as the empty text; other columns stay out of the way."""
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what a finished task of a Python worker no longer uses, as idle workers stay beside the next stage's work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def hash_sample(df: DataFrame, n: int, rows: int, order: Column) -> DataFrame:
    """The ``rows`` rows of ``df``, which has about ``n``, with the least ``order`` (a hash, as bigint).

    Rows far above the wanted share of hashes are left out before they are ranked, so that what the tasks send to be ranked does not
    grow with their number.
    """
    if n > 4 * rows:
        df = df.where(order < F.lit(int(-(2**63) + 2**64 * (2 * rows / n))))
    return df.orderBy(order).limit(rows)


def fold(id_column: str | Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id is in fold 0."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))
