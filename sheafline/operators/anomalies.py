"""Outliers by interquartile range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError, check_range
from sheafline.functions.numbers import half_even, is_finite, share_percent
from sheafline.operators.columns import column, numeric_column, resolve_column
from sheafline.operators.quantiles import exact_quantiles
from sheafline.operators.cleanup import with_row_index
from sheafline.operators.skew import lookup_by_key

# The usual fence factor, and the fewest values that can have outliers.
FENCE = 1.5
MIN_VALUES = 4
MAX_LISTED = 1000
FENCE_QUANTILES = (0.0, 0.25, 0.75, 1.0)
ROUNDED = ("q1", "q3", "iqr", "lower_bound", "upper_bound")


def iqr_bounds(df: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Unrounded ``(*by, valid_count, q1, q3, iqr, lower_bound, upper_bound)`` of the finite values.

    Fewer than four values have no outliers: their bounds are their minimum and maximum. A table
    without ``by`` always yields one row, zeros when it holds no value.
    """
    metric, value = numeric_column(df, metric)
    keys = [resolve_column(df, b) for b in by]
    finite = df.select(*[column(b) for b in keys], F.when(is_finite(value), value).alias("_value"))
    bounds = fences(exact_quantiles(finite, {metric: F.col("_value")}, FENCE_QUANTILES, keys), keys)
    if keys:
        return bounds
    # An aggregate without keys has a row even for no input.
    return bounds.agg(*[F.coalesce(F.max(c), F.lit(0)).cast(t).alias(c) for c, t in bounds.dtypes])


def fences(quantiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, valid_count, q1, q3, iqr, lower_bound, upper_bound)`` from exact ``FENCE_QUANTILES``."""
    n = F.col("total")
    low, q1, q3, high = (F.get("quantiles", F.lit(i)) for i in range(4))
    few = n < MIN_VALUES
    spread = q3 - q1
    return quantiles.select(
        *[column(b) for b in keys],
        n.alias("valid_count"),
        F.when(few, low).otherwise(q1).alias("q1"),
        F.when(few, high).otherwise(q3).alias("q3"),
        F.when(few, 0.0).otherwise(spread).alias("iqr"),
        F.when(few, low).otherwise(q1 - FENCE * spread).alias("lower_bound"),
        F.when(few, high).otherwise(q3 + FENCE * spread).alias("upper_bound"),
    )


def _with_bounds(df: DataFrame, value: Column, keys: list[str], bounds: DataFrame) -> DataFrame:
    """Each row beside the bounds of its group."""
    rows = df.withColumn("_value", value)
    fields = ["lower_bound", "upper_bound"]
    if not keys:
        # One row of bounds: evaluated once, then a constant in the filter.
        pair = bounds.select(F.struct(*fields)).scalar()
        return rows.withColumn("_bounds", pair)
    # One group, and one value of it, may hold much of the table: the bounds of the heaviest groups are broadcast, a fixed number of
    # them, and the rows that they answer are spread by place.
    group = F.to_json(F.struct(*[column(b).alias(f"k{i}") for i, b in enumerate(keys)]))
    named = bounds.select(group.alias("_group"), "valid_count", F.struct(*fields).alias("_bounds"))
    found = lookup_by_key(rows.withColumn("_group", group), named, "_group", "valid_count", "_bounds", F.monotonically_increasing_id())
    return found.filter(F.col("_bounds").isNotNull()).drop("_group")


def flag_anomalies(
    df: DataFrame,
    metric: str,
    date: str | None = None,
    dimension: str | None = None,
    by: Sequence[str] = (),
    key: str | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Every outlier: ``(*by, row_index, value, direction, deviation[, date][, category])``.

    ``key`` names a column that identifies rows and orders ties. Without one, rows are numbered
    in storage order, which costs a checkpointed copy of the table. A value is an outlier when it
    lies strictly outside the bounds.
    """
    metric, value = numeric_column(df, metric)
    keys = [resolve_column(df, b) for b in by]
    extra = []
    if date:
        extra.append(column(resolve_column(df, date)).cast("string").alias("date"))
    if dimension:
        extra.append(column(resolve_column(df, dimension)).cast("string").alias("category"))
    if key is None:
        df = with_row_index(df, "_row")
        index = F.col("_row")
    else:
        index = column(resolve_column(df, key))
    if bounds is None:
        bounds = iqr_bounds(df, metric, keys)
    low, high = F.col("_bounds.lower_bound"), F.col("_bounds.upper_bound")
    seen = F.col("_value")
    checked = _with_bounds(df.filter(is_finite(value)), value, keys, bounds)
    outside = checked.filter((seen < low) | (seen > high))
    return outside.select(
        *[column(b) for b in keys],
        index.alias("row_index"),
        seen.alias("value"),
        F.when(seen > high, "high").otherwise("low").alias("direction"),
        F.when(seen > high, seen - high).otherwise(low - seen).alias("deviation"),
        *extra,
    )


def detect_anomalies(
    df: DataFrame,
    metric: str,
    date: str | None = None,
    dimension: str | None = None,
    limit: int = 20,
    key: str | None = None,
) -> DataFrame:
    """The outliers farthest outside the bounds, ties in row order; ``limit`` trims only this list."""
    check_range(limit, 1, MAX_LISTED, "INVALID_LIMIT", "Limit")
    found = flag_anomalies(df, metric, date, dimension, key=key)
    return found.orderBy(F.col("deviation").desc(), "row_index").limit(limit)


def anomaly_summary(
    df: DataFrame, metric: str, by: Sequence[str] = (), validate: bool = True
) -> DataFrame:
    """``(*by, column, method, q1, q3, iqr, lower_bound, upper_bound, anomaly_count,
    anomaly_percentage, normal_count)`` per group, figures rounded after the rows were judged.
    """
    if validate and df.isEmpty():
        raise AnalyticsError("EMPTY_DATASET", "The table has no rows.")
    name, value = numeric_column(df, metric)
    keys = [resolve_column(df, b) for b in by]
    bounds = iqr_bounds(df, name, keys)
    checked = _with_bounds(df.filter(is_finite(value)), value, keys, bounds)
    outside = (F.col("_value") < F.col("_bounds.lower_bound")) | (F.col("_value") > F.col("_bounds.upper_bound"))
    counts = checked.groupBy(*[column(b) for b in keys]).agg(F.count_if(outside).alias("anomaly_count"))
    if keys:
        left = bounds.select(*[column(b).alias(f"_b{i}") for i, b in enumerate(keys)], "valid_count", *ROUNDED)
        same = None
        for i, b in enumerate(keys):
            matches = column(b).eqNullSafe(F.col(f"_b{i}"))
            same = matches if same is None else same & matches
        joined = counts.join(left, same)
    else:
        joined = bounds.withColumn("anomaly_count", counts.scalar())
    return joined.select(
        *[column(b) for b in keys],
        F.lit(name).alias("column"),
        F.lit("IQR").alias("method"),
        *[half_even(F.col(c), 4).alias(c) for c in ROUNDED],
        "anomaly_count",
        share_percent(F.col("anomaly_count"), F.col("valid_count")).alias("anomaly_percentage"),
        (F.col("valid_count") - F.col("anomaly_count")).alias("normal_count"),
    )
