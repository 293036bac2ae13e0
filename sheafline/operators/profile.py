"""Column profiles: semantic types, distinct counts, statistics, top values, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.errors import AnalyticsError
from sheafline.functions.dates import iso_text, whole_days
from sheafline.functions.numbers import finite_or_null, half_even, is_numeric, share_percent
from sheafline.functions.text import SHORT_TEXT, identity_key
from sheafline.operators.aggregate import describe
from sheafline.operators.cleanup import json_safe_value
from sheafline.operators.columns import (
    column,
    date_readings,
    is_text,
    is_timestamp,
    missing_as_null,
)
from sheafline.operators.identifiers import identifier_columns

# Name parts that hint at a date, and the thresholds of the semantic types.
DATE_HINTS = ("date", "time", "timestamp", "year", "month", "day", "created", "updated")
DATE_PARSE_RATIO = 0.8
MAX_CATEGORIES = 50
MAX_CATEGORY_RATIO = 0.25
SAMPLE_VALUES = 5
TOP_VALUES = 5


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows ``(name, unique_count)`` of the non-missing values of each column.

    Exact counts aggregate one column at a time: together the scans read each column once, and no
    row is multiplied the way several DISTINCTs in one aggregate would. ``approx`` counts all
    columns in one pass with a relative standard deviation of five percent.
    """
    clean, types = missing_as_null(df), _field_types(df)
    keys = {c: identity_key(column(c), t) for c, t in types.items()}
    if approx:
        wide = clean.agg(*[F.approx_count_distinct(k).alias(f"n{i}") for i, k in enumerate(keys.values())])
        pairs = [F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("unique_count")) for i, c in enumerate(keys)]
        return wide.select(F.inline(F.array(*pairs)))
    return _union([
        clean.groupBy(k.alias("k")).agg(F.lit(1).alias("one"))
        .agg(F.count("k").alias("unique_count")).select(F.lit(c).alias("name"), "unique_count")
        for c, k in keys.items()
    ])


def sample_values(df: DataFrame, count: int = SAMPLE_VALUES) -> dict[str, list[str]]:
    """The first non-missing values of each column in storage order, as text.

    A few leading rows usually suffice; only a column that is sparse there is read further, and
    Spark stops reading it at the ``count``-th value.
    """
    types = _field_types(df)
    shown = missing_as_null(df).select(
        [json_safe_value(column(c), t).cast("string").alias(c) if not isinstance(t, (T.StructType, T.ArrayType, T.MapType))
         else F.to_json(F.struct(json_safe_value(column(c), t).alias("v"))).alias(c) for c, t in types.items()]
    )
    head = shown.take(10 * count)
    samples = {}
    for i, c in enumerate(df.columns):
        found = [row[i] for row in head if row[i] is not None][:count]
        if len(found) < count and len(head) == 10 * count:
            found = [row[0] for row in shown.select(column(c)).filter(column(c).isNotNull()).take(count)]
        samples[c] = found
    return samples


def hinted_dates(df: DataFrame) -> dict[str, Column]:
    """Text columns with a date-like name in which values look like dates, and the expression that reads them."""
    hinted = [c for c, t in _field_types(df).items() if is_text(t) and any(hint in c.lower() for hint in DATE_HINTS)]
    return date_readings(df, hinted)


def column_facts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: ``ordinal, name, dtype, rows, null_count, null_percentage, unique_count,
    semantic_type, zeros, ones, first_date, last_date``.

    A numeric column whose values are all 0 or 1 is boolean. A text column is a date when its
    name hints at one and 80 % of its values can be read as dates. Other texts are categories when few or mostly repeated.
    """
    clean, types = missing_as_null(df), _field_types(df)
    readings = hinted_dates(df)
    null_long, null_text = F.lit(None).cast("long"), F.lit(None).cast("string")

    parts = []
    for c, t in types.items():
        cell = column(c)
        if is_numeric(t):
            other = F.count_if((cell != 0) & (cell != 1))
            zeros, ones = F.count_if(cell == 0), F.count_if(cell == 1)
        elif isinstance(t, T.BooleanType):
            other, zeros, ones = F.lit(0).cast("long"), F.count_if(~cell), F.count_if(cell)
        else:
            other, zeros, ones = null_long, null_long, null_long
        if is_timestamp(t):
            when = cell.cast("timestamp_ntz") if isinstance(t, T.DateType) else cell
        else:
            when = readings.get(c)
        parts.append(F.struct(
            F.count(cell).alias("present"),
            other.alias("other"), zeros.alias("zeros"), ones.alias("ones"),
            (F.count(when) if when is not None else null_long).alias("dates"),
            (iso_text(F.min(when)) if when is not None else null_text).alias("first_date"),
            (iso_text(F.max(when)) if when is not None else null_text).alias("last_date"),
            (whole_days(F.min(when), F.max(when)) if when is not None else null_long).alias("range_days"),
        ))
    wide = clean.agg(F.count(F.lit(1)).alias("rows"), *[p.alias(f"c{i}") for i, p in enumerate(parts)])
    kinds = {c: ("boolean" if isinstance(t, T.BooleanType) else "numeric" if is_numeric(t)
                 else "datetime" if is_timestamp(t) else "text") for c, t in types.items()}
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("name"), F.lit(types[c].simpleString()).alias("dtype"),
            F.lit(kinds[c]).alias("stored_kind"), F.col(f"c{i}").alias("f"),
        )
        for i, c in enumerate(types)
    ])
    facts = wide.select("rows", F.inline(entries)).select("*", "f.*").drop("f")
    # A handful of rows on either side: one per column of the table.
    facts = facts.join(F.broadcast(distinct_counts(df, approx)), "name")
    share = F.col("dates") / F.nullif(F.col("present"), F.lit(0))
    few = (F.col("unique_count") <= MAX_CATEGORIES) | (F.col("unique_count") / F.col("present") < MAX_CATEGORY_RATIO)
    kind = F.col("stored_kind")
    semantic = (
        F.when(kind == "boolean", "boolean")
        .when(kind == "numeric", F.when((F.col("present") > 0) & (F.col("other") == 0), "boolean").otherwise("numeric"))
        .when(kind == "datetime", "datetime")
        .when(share >= DATE_PARSE_RATIO, "datetime")
        .when(F.col("present") == 0, "unknown")
        .when(few, "categorical")
        .otherwise("text")
    )
    nulls = F.col("rows") - F.col("present")
    return facts.select(
        "ordinal", "name", "dtype", "rows", nulls.alias("null_count"),
        share_percent(nulls, F.col("rows")).alias("null_percentage"),
        "unique_count", semantic.alias("semantic_type"), "zeros", "ones", "first_date", "last_date", "range_days",
    )


def numeric_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows ``(name, min, max, mean, median, std, q25, q75)`` of the numeric columns that hold values."""
    types = _field_types(df)
    names = names if names is not None else [c for c, t in types.items() if is_numeric(t)]
    schema = "name string, min double, max double, mean double, median double, std double, q25 double, q75 double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    narrow = missing_as_null(df.select([column(c) for c in names]))
    narrow = narrow.select([column(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    stats = describe(narrow, {c: F.col(f"v{i}") for i, c in enumerate(names)}).filter(F.col("count") > 0)
    several = F.col("count") > 1
    return stats.select(
        F.col("metric").alias("name"),
        finite_or_null(F.col("min")).alias("min"),
        finite_or_null(F.col("max")).alias("max"),
        *[half_even(F.col(c), 4).alias(c) for c in ("mean", "median", "std")],
        F.when(several, half_even(F.col("q25"), 4)).alias("q25"),
        F.when(several, half_even(F.col("q75"), 4)).alias("q75"),
    )


def datetime_profile(facts: DataFrame) -> DataFrame:
    """Rows ``(name, min_date, max_date, range_days)`` of the date columns."""
    dates = facts.filter((F.col("semantic_type") == "datetime") & F.col("first_date").isNotNull())
    return dates.select("name", F.col("first_date").alias("min_date"), F.col("last_date").alias("max_date"), "range_days")


def top_values(df: DataFrame, names: list[str], count: int = TOP_VALUES) -> DataFrame:
    """Rows ``(name, rank, value, count)``: the most frequent values of each column.

    Ties go by the value, or by the digest of a long text. Each column is counted on its own and
    ranked by TakeOrdered; long texts are counted by digest, and only the winners are looked up.
    """
    schema = "name string, rank long, value string, count long"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    clean, types = missing_as_null(df), _field_types(df)
    parts = []
    for c in names:
        key = identity_key(column(c), types[c])
        shown = F.initcap(column(c).cast("string")) if isinstance(types[c], T.BooleanType) else column(c).cast("string")
        counted = clean.filter(column(c).isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("count"))
        best = counted.orderBy(F.desc("count"), "k").limit(count)
        if is_text(types[c]):
            # At most ``count`` digests: find their texts, one row per digest. DISTINCT aggregates
            # by hash, so the copies of a text collapse in each task without being sorted.
            wanted = best.filter(F.length("k") > SHORT_TEXT).select("k")
            texts = (
                clean.filter(F.length(column(c)) > SHORT_TEXT).select(key.alias("k"), shown.alias("long_value"))
                .join(F.broadcast(wanted), "k").distinct()
            )
            best = best.join(F.broadcast(texts), "k", "left").select(
                "k", "count", F.coalesce("long_value", "k").alias("value")
            )
        else:
            as_text = F.col("k").cast("string")
            shown_key = F.initcap(as_text) if isinstance(types[c], T.BooleanType) else as_text
            best = best.select("k", "count", shown_key.alias("value"))
        # At most ``count`` rows are numbered.
        rank = F.row_number().over(Window.orderBy(F.desc("count"), "k")).cast("long")
        parts.append(best.select(F.lit(c).alias("name"), rank.alias("rank"), "value", "count"))
    return _union(parts)


def profile_columns(
    df: DataFrame, approx: bool = False, samples: bool = True
) -> DataFrame:
    """One row per column: type, missing and distinct counts, samples and the figures of its type.

    Reads the table four times: plain aggregates, distinct counts, quartiles and top values.
    """
    if not df.columns:
        raise AnalyticsError("EMPTY_DATASET", "The table has no columns.")
    types = _field_types(df)
    facts = column_facts(df, approx)
    numbers = numeric_profile(df)
    texts = [c for c, t in types.items() if is_text(t)]
    tops = top_values(df, texts).groupBy("name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
            lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count")),
        ).alias("text_tops")
    )
    kept = sample_values(df) if samples else {}
    listed = df.sparkSession.createDataFrame(
        [(c, kept.get(c, []), bool(c in identifiers)) for identifiers in [set(identifier_columns(df))] for c in df.columns],
        "name string, sample_values array<string>, is_identifier boolean",
    )
    # Every side has one row per column of the table.
    joined = facts
    for side in (numbers, tops, listed):
        joined = joined.join(F.broadcast(side), "name", "left")
    semantic = F.col("semantic_type")
    is_number, is_date = semantic == "numeric", semantic == "datetime"
    flag = F.col("dtype") == "boolean"
    pair = F.array(
        F.struct(F.when(flag, "False").otherwise("0").alias("value"), F.col("zeros").alias("count")),
        F.struct(F.when(flag, "True").otherwise("1").alias("value"), F.col("ones").alias("count")),
    )
    flags = F.filter(
        F.when(F.col("ones") > F.col("zeros"), F.reverse(pair)).otherwise(pair), lambda v: v["count"] > 0
    )
    stats = ("min", "max", "mean", "median", "std", "q25", "q75")
    return joined.select(
        "ordinal", "name", "dtype", "semantic_type", "is_identifier", "null_count", "null_percentage", "unique_count",
        "sample_values",
        *[F.when(is_number, F.col(c)).alias(c) for c in stats],
        F.when(is_date, F.col("first_date")).alias("min_date"),
        F.when(is_date, F.col("last_date")).alias("max_date"),
        F.when(is_date, F.col("range_days")).alias("range_days"),
        F.when(semantic == "boolean", flags)
        .when(semantic.isin("categorical", "text"), F.col("text_tops"))
        .alias("top_values"),
    )
