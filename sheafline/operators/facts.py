"""Results as sentences: small tables ``(ord, fact)``, written from the operators' result tables.

The sentence patterns are fixed values: consumers match on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.dates import display_period
from sheafline.functions.numbers import display_number, plain_number
from sheafline.operators.columns import column

DEFAULT_KPIS = 4

WINNER = "{} generated the most {}: {}."
CATEGORY = "{} '{}' had {} of {}."
PERIOD = "{} ({}) {}: {}."
FORECAST_BASIS = "Forecasted {} for the next {} {} period(s) based on {} historical observations."
FORECAST_SLOPE = "Observed {} linear trend with a slope of {} per {} period."
PROJECTED = "Projected {} for {}: {}."
ANOMALY_COUNT = "Detected {} statistical anomalies in {} ({}% of {} observations)."
ANOMALY_BOUNDS = "IQR bounds for {}: lower bound = {}, upper bound = {} (Q1 = {}, Q3 = {}, IQR = {})."
ANOMALY_ROW = "Row {}: {} in {}: {}{}"
METRIC = "Metric '{}': Total={}, Avg={}, Min={}, Max={}."


def sentence(pattern: str, *values: Column | str) -> Column:
    """``pattern`` with each ``{}`` replaced by a value; a missing value shows as nothing."""
    texts = pattern.split("{}")
    parts = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        shown = F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))
        parts += [shown, F.lit(text)]
    return F.concat(*parts)


def _lines(row: DataFrame, *sentences: Column) -> DataFrame:
    """The sentences of a one-row table, in order."""
    return row.select(F.posexplode(F.array(*sentences)).alias("ord", "fact")).withColumn("ord", F.col("ord").cast("long"))


def _after(first: DataFrame, count: int, rest: DataFrame) -> DataFrame:
    return first.unionByName(rest.withColumn("ord", F.col("ord") + count))


def top_facts(ranked: DataFrame, dimension: str, metric: str) -> DataFrame:
    """From ``(rank, category, value)``: the winner, then each category."""
    value = display_number(F.col("value"))
    winner = ranked.filter(F.col("rank") == 1)
    lead = _lines(winner, sentence(WINNER, F.col("category"), metric.lower(), value))
    each = ranked.select(
        (F.col("rank") - 1).alias("ord"),
        sentence(CATEGORY, dimension, F.col("category"), metric, value).alias("fact"),
    )
    return _after(lead, 1, each)


def trend_facts(trend: DataFrame, metric: str) -> DataFrame:
    """From ``(period, value)``: one sentence per period, in label order."""
    order = F.row_number().over(Window.orderBy("period")).cast("long") - 1
    text = sentence(PERIOD, display_period(F.col("period")), F.col("period"), metric, display_number(F.col("value")))
    return trend.select(order.alias("ord"), text.alias("fact"))


def direction_word(direction: Column) -> Column:
    return F.when(direction == "up", "upward").when(direction == "down", "downward").otherwise("flat")


def forecast_facts(forecast: DataFrame, metric: str, periods: int) -> DataFrame:
    """From a forecast of one series: basis, trend, and each projected value."""
    projected = forecast.filter(F.col("kind") == "projected")
    basis = projected.orderBy("step").limit(1)
    lead = _lines(
        basis,
        sentence(FORECAST_BASIS, metric, str(periods), F.col("frequency"), F.col("historical_count")),
        sentence(FORECAST_SLOPE, direction_word(F.col("direction")), display_number(F.col("slope")), F.col("frequency")),
    )
    each = projected.select(
        (F.col("step") - F.col("historical_count")).alias("ord"),
        sentence(PROJECTED, metric, display_period(F.col("period")), display_number(F.col("value"))).alias("fact"),
    )
    return _after(lead, 2, each)


def outlier_word(direction: Column) -> Column:
    return F.when(direction == "high", "High outlier").otherwise("Low outlier")


def outlier_setting(date: Column | None = None, category: Column | None = None) -> Column:
    """`` (Date: ..., Category: ...)`` of what is known about an outlier, else nothing."""
    parts = [F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), c)) for c, label in ((date, "Date"), (category, "Category")) if c is not None]
    joined = F.concat_ws(", ", *parts) if parts else F.lit("")
    return F.when(F.length(joined) > 0, F.concat(F.lit(" ("), joined, F.lit(")"))).otherwise("")


def anomaly_facts(summary: DataFrame, listed: DataFrame, metric: str) -> DataFrame:
    """From a one-row summary and the listed outliers: counts, bounds, and each outlier."""
    shown = {c: display_number(F.col(c)) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")}
    total = F.col("anomaly_count") + F.col("normal_count")
    lead = _lines(
        summary,
        sentence(ANOMALY_COUNT, F.col("anomaly_count"), metric, plain_number(F.col("anomaly_percentage")), total),
        sentence(ANOMALY_BOUNDS, metric, shown["lower_bound"], shown["upper_bound"], shown["q1"], shown["q3"], shown["iqr"]),
    )
    setting = outlier_setting(**{c: column(c) for c in ("date", "category") if c in listed.columns})
    order = F.row_number().over(Window.orderBy(F.desc("deviation"), "row_index")).cast("long") - 1
    each = listed.select(
        order.alias("ord"),
        sentence(ANOMALY_ROW, F.col("row_index"), outlier_word(F.col("direction")), metric, display_number(F.col("value")), setting).alias("fact"),
    )
    return _after(lead, 2, each)


def kpi_facts(kpis: DataFrame) -> DataFrame:
    """One sentence per metric with plain figures, in column order."""
    figures = kpis.filter(~F.col("excluded"))
    text = sentence("Column '{}' Total: {}, Avg: {}, Min: {}, Max: {}.", F.col("metric"),
                    *[plain_number(F.col(c)) for c in ("total", "average", "minimum", "maximum")])
    return figures.select(F.col("ordinal").cast("long").alias("ord"), text.alias("fact"))


def size_facts(quality: DataFrame, filename: str) -> DataFrame:
    """Rows and columns, and the score, of a table as two sentences."""
    return _lines(
        quality,
        sentence("Dataset '{}' has {} rows and {} columns.", filename, F.col("rows"), F.col("columns")),
        sentence("Data quality health score is {}% with {} missing cells ({}%).",
                 plain_number(F.col("score")), F.col("missing_cells"), plain_number(F.col("missing_percentage"))),
    )


def metric_sentence() -> Column:
    """The sentence of one row of KPIs."""
    return sentence(METRIC, F.col("metric"), *[display_number(F.col(c)) for c in ("total", "average", "minimum", "maximum")])


def overview_facts(quality: DataFrame, kpis: DataFrame, filename: str, question: str, metric: str | None = None) -> DataFrame:
    """The general answer: table size and quality, then the metrics the question names, or the first four."""
    lead = size_facts(quality, filename)
    figures = kpis.filter(~F.col("excluded"))
    name = F.lower(F.col("metric"))
    named = F.lit(question.lower()).contains(name) | (name == F.lit((metric or "").lower()))
    any_named = figures.agg(F.coalesce(F.bool_or(named), F.lit(False))).scalar()
    place = F.row_number().over(Window.orderBy("ordinal"))
    # KPIs have one row per column of a table.
    chosen = figures.withColumn("_place", place).filter(F.when(any_named, named).otherwise(F.col("_place") <= DEFAULT_KPIS))
    return _after(lead, 2, chosen.select((F.col("_place") - 1).cast("long").alias("ord"), metric_sentence().alias("fact")))


def quality_facts(quality: DataFrame, filename: str) -> DataFrame:
    """Score, missing cells and duplicates as three sentences."""
    return _lines(
        quality,
        sentence("Dataset '{}' overall health score is {}%.", filename, plain_number(F.col("score"))),
        sentence("Missing cells: {} ({}%).", F.col("missing_cells"), plain_number(F.col("missing_percentage"))),
        sentence("Duplicate rows: {} ({}%).", F.col("duplicate_rows"), plain_number(F.col("duplicate_percentage"))),
    )
