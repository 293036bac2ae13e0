"""Series for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.functions.numbers import nan_to_null
from sheafline.operators.columns import column, dtype_of, resolve_column

CHART_POINTS = 15


def _counted(df: DataFrame, x: str) -> DataFrame:
    name = resolve_column(df, x)
    key = nan_to_null(column(name), dtype_of(df, name))
    return df.groupBy(key.alias("x")).agg(F.count(F.lit(1)).alias("count"))


def value_counts_chart(df: DataFrame, x: str, points: int = CHART_POINTS) -> DataFrame:
    """Bar or pie: the most frequent values, ties in value order."""
    present = _counted(df, x).filter(F.col("x").isNotNull())
    return present.orderBy(F.desc("count"), "x").limit(points)


def line_chart(df: DataFrame, x: str, points: int = CHART_POINTS) -> DataFrame:
    """Line: rows per value in value order, the missing value last."""
    return _counted(df, x).orderBy(F.col("x").asc_nulls_last()).limit(points)


def map_chart(df: DataFrame, series: str) -> DataFrame:
    """A series given as a map column, as rows ``(x, y)``."""
    return df.select(F.explode(column(resolve_column(df, series))).alias("x", "y"))
