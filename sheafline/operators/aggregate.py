"""Statistics, grouping by category, ranking and KPIs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.errors import AnalyticsError, check_range
from sheafline.functions.numbers import finite_or_null, half_even
from sheafline.operators.columns import as_number, column, dtype_of, is_text, numeric_column, resolve_column
from sheafline.operators.identifiers import identifier_columns
from sheafline.operators.quantiles import exact_quantiles

# The aggregations a caller may ask for, and the label of the missing category.
AGGREGATIONS = ("sum", "mean", "count", "min", "max")
MISSING_LABEL = "Unknown / Missing"
MAX_RANKED = 100


def aggregation_name(aggregation: str) -> str:
    name = aggregation.strip().lower()
    if name not in AGGREGATIONS:
        raise AnalyticsError("INVALID_AGGREGATION", f"Unsupported aggregation {aggregation!r}; use one of {AGGREGATIONS}.")
    return name


def aggregate_value(value: Column, aggregation: str) -> Column:
    """One aggregation as DOUBLE: a sum of nothing is 0, a mean has four decimals."""
    if aggregation == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0)).cast("double")
    if aggregation == "mean":
        return half_even(F.avg(value), 4)
    if aggregation == "count":
        return F.count(value).cast("double")
    return (F.min(value) if aggregation == "min" else F.max(value)).cast("double")


def metric_value(df: DataFrame, metric: str | None, aggregation: str, fallback: Column) -> Column:
    """The expression to aggregate; counting accepts any column, or the fallback without one."""
    if aggregation != "count":
        if not metric:
            raise AnalyticsError("INVALID_COLUMN", f"A metric column is needed for {aggregation}.")
        return numeric_column(df, metric)[1]
    if not metric:
        return fallback
    name = resolve_column(df, metric)
    numeric = as_number(df, name)
    # Counting text counts text; only the NaN of a number is missing.
    return column(name) if numeric is None or is_text(dtype_of(df, name)) else numeric


def category_text(key: Column, dtype: T.DataType) -> Column:
    """Label of a group key; applied after grouping, so a real value of that text stays apart."""
    text = F.initcap(key.cast("string")) if isinstance(dtype, T.BooleanType) else key.cast("string")
    return F.coalesce(text, F.lit(MISSING_LABEL))


def _grouped(df: DataFrame, category: str, metric: str | None, aggregation: str) -> tuple[DataFrame, T.DataType]:
    operation = aggregation_name(aggregation)
    name = resolve_column(df, category)
    dtype = dtype_of(df, name)
    value = metric_value(df, metric, operation, column(name))
    groups = df.groupBy(column(name).alias("_key")).agg(aggregate_value(value, operation).alias("value"))
    return groups.withColumn("value", finite_or_null(F.col("value"))), dtype


def aggregate_by_category(df: DataFrame, category: str, metric: str | None = None, aggregation: str = "sum") -> DataFrame:
    """Rows ``(category, value)``, one per category, the missing category included."""
    groups, dtype = _grouped(df, category, metric, aggregation)
    return groups.select(category_text(F.col("_key"), dtype).alias("category"), "value")


def sorted_categories(df: DataFrame, category: str, metric: str | None = None, aggregation: str = "sum") -> DataFrame:
    """The same rows in key order, the missing category last: for display of the result."""
    groups, dtype = _grouped(df, category, metric, aggregation)
    ordered = groups.orderBy(F.col("_key").asc_nulls_last())
    return ordered.select(category_text(F.col("_key"), dtype).alias("category"), "value")


def _ranked(groups: DataFrame, dtype: T.DataType, value_order: Column, limit: int) -> DataFrame:
    key_order = F.col("_key").asc_nulls_last()
    best = groups.orderBy(value_order, key_order).limit(limit)
    # At most 100 rows are numbered here.
    rank = F.row_number().over(Window.orderBy(value_order, key_order)).cast("long")
    return best.select(rank.alias("rank"), category_text(F.col("_key"), dtype).alias("category"), "value")


def top_categories(
    df: DataFrame, category: str, metric: str | None = None, aggregation: str = "sum", limit: int = 10
) -> DataFrame:
    """The highest categories; missing values last, ties in key order."""
    check_range(limit, 1, MAX_RANKED, "INVALID_LIMIT", "Limit")
    groups, dtype = _grouped(df, category, metric, aggregation)
    return _ranked(groups, dtype, F.col("value").desc_nulls_last(), limit)


def bottom_categories(
    df: DataFrame, category: str, metric: str | None = None, aggregation: str = "sum", limit: int = 10
) -> DataFrame:
    """The lowest categories that have a value, ties in key order."""
    check_range(limit, 1, MAX_RANKED, "INVALID_LIMIT", "Limit")
    groups, dtype = _grouped(df, category, metric, aggregation)
    return _ranked(groups.filter(F.col("value").isNotNull()), dtype, F.col("value").asc(), limit)


# Quartiles in the order every caller below reads them.
QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Exact descriptive statistics of several metrics.

    Rows ``(*by, metric, count, missing, min, max, mean, std, sum, q25, median, q75)``. All but
    the quartiles take one pass over the table; for those see ``quantiles``.
    """
    keys = [column(b) for b in by]
    narrow = df.select(*keys, *[v.alias(f"_v{i}") for i, v in enumerate(values.values())])

    def stats(v: str) -> str:
        return (f"struct(count({v}) as count, count_if({v} is null) as missing, min({v}) as min, max({v}) as max, avg({v}) as mean, "
                f"stddev_samp({v}) as std, coalesce(sum({v}), 0D) as sum)")

    wide = narrow.groupBy(*keys).agg(*[F.expr(stats(f"_v{i}")).alias(f"_m{i}") for i in range(len(values))])
    fields = ["count", "missing", "min", "max", "mean", "std", "sum"]
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"_m{i}.{f}") for f in fields]) for i, m in enumerate(values)
    ])
    long = wide.select(*keys, F.inline(entries))
    quartiles = exact_quantiles(df, values, QUARTILES, by).select(
        *[column(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("metric").alias("_metric"), F.col("quantiles").alias("q"),
    )
    same = F.col("metric") == F.col("_metric")
    for i, b in enumerate(by):
        same = same & column(b).eqNullSafe(F.col(f"_b{i}"))
    long = long.join(quartiles, same, "left")
    std = F.when(F.col("count") == 1, F.lit(0.0)).otherwise(F.col("std"))
    return long.select(
        *keys, "metric", "count", "missing", "min", "max", "mean", std.alias("std"), "sum",
        F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"),
    )


def column_statistics(df: DataFrame, name: str) -> DataFrame:
    """One row of statistics of a numeric column; without any value the sum is 0 and the rest NULL."""
    name, value = numeric_column(df, name)
    stats = describe(df.select(value.alias("v")), {name: F.col("v")})
    return stats.select(
        F.col("metric").alias("column"), "count", "missing",
        *[finite_or_null(F.col(c)).alias(c) for c in ("min", "max")],
        half_even(F.col("mean"), 4).alias("mean"),
        finite_or_null(F.col("median")).alias("median"),
        half_even(F.col("std"), 4).alias("standard_deviation"),
        finite_or_null(F.col("sum")).alias("sum"),
    )


def kpi_candidates(df: DataFrame) -> dict[str, Column]:
    """Numeric-like columns: numbers, booleans, and texts of which any value is a number."""
    found = {c: as_number(df, c) for c in df.columns}
    found = {c: v for c, v in found.items() if v is not None}
    texts = [c for c in found if is_text(dtype_of(df, c))]
    if texts:
        parsed = df.agg(*[F.count(found[c]).alias(f"t{i}") for i, c in enumerate(texts)]).first()
        for i, c in enumerate(texts):
            if not parsed[i]:
                del found[c]
    return found


def kpis(df: DataFrame) -> DataFrame:
    """Total, average, minimum, maximum, median and count of every business metric.

    One row per numeric-like column in column order. ``excluded`` marks identifier columns, which
    carry no figures; columns without any value are left out.
    """
    values = kpi_candidates(df)
    schema = "ordinal int, metric string, excluded boolean, total double, average double, minimum double, maximum double, median double, count long"
    if not values:
        return df.sparkSession.createDataFrame([], schema)
    identifiers = set(identifier_columns(df, list(values), read_texts=True))
    order = {c: i for i, c in enumerate(df.columns)}
    business = {c: v for c, v in values.items() if c not in identifiers}
    spark = df.sparkSession
    excluded = spark.createDataFrame(
        [(order[c], c, True, None, None, None, None, None, None) for c in values if c in identifiers], schema
    )
    if not business:
        return excluded
    narrow = df.select([v.alias(f"v{i}") for i, v in enumerate(business.values())])
    stats = describe(narrow, {m: F.col(f"v{i}") for i, m in enumerate(business)}).filter(F.col("count") > 0)
    ordinal = F.create_map(*[F.lit(x) for c in business for x in (c, order[c])])[F.col("metric")]
    figures = stats.select(
        ordinal.alias("ordinal"), "metric", F.lit(False).alias("excluded"),
        finite_or_null(F.col("sum")).alias("total"),
        half_even(F.col("mean"), 2).alias("average"),
        finite_or_null(F.col("min")).alias("minimum"),
        finite_or_null(F.col("max")).alias("maximum"),
        finite_or_null(F.col("median")).alias("median"),
        "count",
    )
    # A row per column of the table.
    return figures.unionByName(excluded).orderBy("ordinal")
