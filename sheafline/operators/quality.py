"""Table quality: missing cells, duplicates, empty and constant parts, and the 0-100 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.numbers import half_even, share_percent
from sheafline.functions.text import identity_key
from sheafline.operators.columns import column, missing_as_null

# Points taken off per percent missing, per percent duplicated, and per empty
# column, empty row and constant column.
PENALTIES = {"missing": 0.4, "duplicate": 0.4, "empty_column": 5.0, "empty_row": 5.0, "constant_column": 2.0}


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``(rows, distinct_rows, duplicate_rows, duplicate_percentage)``.

    Equal rows are counted before anything is shuffled, so a row copied a billion times costs one
    record per task; long texts travel as digests.
    """
    names = columns or df.columns
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    clean = missing_as_null(df.select([column(c) for c in names]))
    keys = [identity_key(column(c), types[c]).alias(f"k{i}") for i, c in enumerate(names)]
    copies = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    counted = copies.agg(rows.alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    repeated = F.col("rows") - F.col("distinct_rows")
    return counted.select(
        "rows", "distinct_rows", repeated.alias("duplicate_rows"),
        share_percent(repeated, F.col("rows")).alias("duplicate_percentage"),
    )


def quality_score(missing_pct: Column, duplicate_pct: Column, empty_columns: Column, empty_rows: Column, constant_columns: Column) -> Column:
    """Score from the already rounded percentages, one decimal, between 0 and 100."""
    deductions = (
        missing_pct * PENALTIES["missing"]
        + duplicate_pct * PENALTIES["duplicate"]
        + empty_columns * PENALTIES["empty_column"]
        + empty_rows * PENALTIES["empty_row"]
        + constant_columns * PENALTIES["constant_column"]
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_even(100.0 - deductions, 1)))


def _orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def cell_summary(df: DataFrame) -> DataFrame:
    """One row of the checks that need no distinct: a single aggregate over the table.

    A column is constant when its minimum equals its maximum; columns whose type has no order
    compare their JSON text.
    """
    clean = missing_as_null(df)
    types = [f.dataType for f in clean.schema.fields]
    cells = [column(c) for c in clean.columns]
    comparable = [c if _orderable(t) else F.to_json(F.struct(c.alias("v"))) for c, t in zip(cells, types)]
    all_missing = cells[0].isNull()
    for cell in cells[1:]:
        all_missing = all_missing & cell.isNull()
    raw = clean.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(all_missing).alias("empty_rows"),
        F.array(*[F.count(c) for c in cells]).alias("present"),
        F.array(*[F.coalesce(F.min(c) == F.max(c), F.lit(False)) for c in comparable]).alias("one_value"),
    )
    names = F.array(*[F.lit(c) for c in df.columns])
    missing = F.transform("present", lambda n: F.col("rows") - n)
    with_missing = F.transform(
        F.filter(F.arrays_zip(missing.alias("m"), names.alias("name")), lambda z: z["m"] > 0), lambda z: z["name"]
    )
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    return raw.select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        total(missing).alias("missing_cells"),
        with_missing.alias("columns_with_missing"),
        "empty_rows",
        F.size(F.filter("present", lambda n: n == 0)).cast("long").alias("empty_columns"),
        F.size(F.filter("one_value", lambda same: same)).cast("long").alias("constant_columns"),
    )


def table_quality(df: DataFrame) -> DataFrame:
    """One row with every quality figure and the score."""
    cells = cell_summary(df)
    repeats = duplicate_summary(df).select(F.struct("duplicate_rows", "duplicate_percentage").alias("d")).scalar()
    size = F.col("rows") * F.col("columns")
    figures = cells.withColumn("_d", repeats).select(
        "rows", "columns", "missing_cells",
        half_even(F.col("missing_cells") / F.greatest(size, F.lit(1)) * 100.0, 2).alias("missing_percentage"),
        "columns_with_missing",
        F.size("columns_with_missing").cast("long").alias("columns_with_missing_count"),
        F.col("_d.duplicate_rows").alias("duplicate_rows"),
        F.col("_d.duplicate_percentage").alias("duplicate_percentage"),
        "empty_rows", "empty_columns", "constant_columns",
    )
    score = quality_score(
        F.col("missing_percentage"), F.col("duplicate_percentage"), F.col("empty_columns"), F.col("empty_rows"),
        F.col("constant_columns"),
    )
    return figures.withColumn("score", score)
