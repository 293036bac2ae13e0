"""Dropping empty rows and columns, flattening structs, JSON-safe values, preview, row index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.errors import AnalyticsError
from sheafline.functions.dates import iso_text
from sheafline.functions.numbers import finite_or_null, is_floating
from sheafline.operators.columns import column, is_timestamp, missing_as_null
from sheafline.session import cut_lineage, written

MAX_PREVIEW_ROWS = 100


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value (one aggregate over the table)."""
    counts = missing_as_null(df).agg(*[F.count(column(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select([column(c) for i, c in enumerate(df.columns) if counts[i] > 0])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every cell is missing."""
    return missing_as_null(df).na.drop("all")


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs become dotted top-level columns; arrays stay as they are."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    def reach(path: tuple[str, ...]) -> Column:
        value = column(path[0])
        for step in path[1:]:
            value = value.getField(step)
        return value.alias(separator.join(path))

    return df.select([reach(path) for path in leaves(df.schema)])


def json_safe_value(value: Column, dtype: T.DataType) -> Column:
    """Value fit for JSON: NaN and infinities are NULL, dates ISO text, the unusual is text."""
    if is_floating(dtype):
        return finite_or_null(value)
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.StringType)):
        return value
    if isinstance(dtype, T.DateType):
        return iso_text(value.cast("timestamp_ntz"))
    if is_timestamp(dtype):
        return iso_text(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: json_safe_value(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [json_safe_value(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType):
        keyed = F.transform_keys(value, lambda k, v: k.cast("string"))
        return F.transform_values(keyed, lambda k, v: json_safe_value(v, dtype.valueType))
    return value.cast("string")


def json_safe(df: DataFrame) -> DataFrame:
    return df.select([json_safe_value(column(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def preview(df: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows, JSON-safe, with the table's row and column totals beside them."""
    if limit < 0:
        raise AnalyticsError("INVALID_LIMIT", "A preview limit cannot be negative.")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    head = json_safe(df.limit(min(limit, MAX_PREVIEW_ROWS)))
    return head.select("*", total.alias("total_rows"), F.lit(len(df.columns)).cast("long").alias("total_columns"))


# Files whose offsets are broadcast; more are joined.
BROADCAST_FILES = 100_000


def _file_rows(df: DataFrame) -> DataFrame | None:
    """``df`` with ``_file`` and ``_at``, each row's place in its file, where the source knows it and ``df`` holds all rows of its files."""
    if "_metadata" in df.columns:
        return None
    try:
        placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return None
    return placed


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Gap-free 0-based row number in storage order, without a global sort.

    Where the files know the number of each row (Parquet, read whole), it is that plus the rows of the files before, by path;
    nothing but a count per file is computed. Other tables are numbered from one checkpointed copy, so that a recomputed or
    re-planned partition cannot shift them. Tables that carry a key of their own should use that key instead: it saves the copy.
    """
    placed = _file_rows(df)
    if placed is not None:
        files = written(placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"), F.max("_at").alias("_last")), "files")
        count, whole = files.agg(F.count(F.lit(1)), F.bool_and(F.col("_rows") == F.col("_last") + 1)).first()
        if whole:
            # A row per file.
            before = F.coalesce(F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            offsets = files.select("_file", before.alias("_offset"))
            known = placed.join(F.broadcast(offsets) if count <= BROADCAST_FILES else offsets, "_file")
            return known.select(*[column(c) for c in df.columns], (F.col("_offset") + F.col("_at")).alias(name))
    marked = cut_lineage(df.withColumn("_mark", F.monotonically_increasing_id()))
    part, local = F.shiftrightunsigned("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition of the table: bounded by the number of tasks, not by the data.
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_mark", "_offset")
    )
