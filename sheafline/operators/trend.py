"""Metrics over calendar periods, and linear projections of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError, check_range
from sheafline.functions.dates import (
    frequency_for_span,
    frequency_name,
    future_label,
    iso_text,
    period_label,
    period_start,
    shift_period,
    whole_days,
)
from sheafline.functions.numbers import finite_or_null, half_even, is_finite
from sheafline.operators.aggregate import aggregate_value, aggregation_name, metric_value
from sheafline.operators.columns import column, datetime_column, numeric_column, resolve_column

MIN_PERIODS = 3
MAX_HORIZON = 24
# Fixed value: slopes within this distance of zero count as flat.
FLAT_SLOPE = 0.001


def _dated(df: DataFrame, date: str, value: Column, by: Sequence[str]) -> tuple[list[str], DataFrame]:
    """Rows ``(*by, ts, v)`` that have a date."""
    by = [resolve_column(df, b) for b in by]
    _, ts = datetime_column(df, date)
    rows = df.select(*[column(b) for b in by], ts.alias("ts"), value.alias("v"))
    return by, rows.filter(F.col("ts").isNotNull())


def _frequency(rows: DataFrame, frequency: str) -> str | Column:
    """The named frequency, or for ``auto`` a value computed inside the plan from the date span."""
    if frequency != "auto":
        return frequency
    span = rows.agg(frequency_for_span(whole_days(F.min("ts"), F.max("ts"))).alias("f"))
    return span.scalar()


def time_trend(
    df: DataFrame,
    date: str,
    metric: str | None = None,
    aggregation: str = "sum",
    frequency: str = "auto",
    by: Sequence[str] = (),
    week_year: str = "calendar",
) -> DataFrame:
    """Rows ``(*by, period, value)`` in order: one per period that has a dated row; gaps stay gaps.

    Periods are grouped by label, so with the default week labels the last days of December fall
    in week 1 of their own calendar year.
    """
    operation, wanted = aggregation_name(aggregation), frequency_name(frequency)
    value = metric_value(df, metric, operation, column(resolve_column(df, date)))
    by, rows = _dated(df, date, value, by)
    label = period_label(F.col("ts"), _frequency(rows, wanted), week_year)
    grouped = rows.groupBy(*[column(b) for b in by], label.alias("period")).agg(
        aggregate_value(F.col("v"), operation).alias("value")
    )
    return grouped.withColumn("value", finite_or_null(F.col("value"))).orderBy(*[column(b) for b in by], "period")


def trend_summary(df: DataFrame, date: str, frequency: str = "auto", week_year: str = "calendar") -> DataFrame:
    """One row ``(frequency, min_date, max_date, span_days, number_of_periods)``.

    Fails with ``NO_VALID_DATES`` when it runs on a table without a single date.
    """
    wanted = frequency_name(frequency)
    _, rows = _dated(df, date, F.lit(1), ())
    chosen = _frequency(rows, wanted)
    label = period_label(F.col("ts"), chosen, week_year)
    per_period = rows.groupBy(label.alias("period")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    span = per_period.agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count("period").alias("n"))
    days = whole_days(F.col("a"), F.col("b"))
    name = F.lit(wanted) if wanted != "auto" else frequency_for_span(days)
    nothing = F.raise_error(F.lit(f"NO_VALID_DATES: column {date!r} holds no dates"))
    return span.select(
        F.when(F.col("n") == 0, nothing.cast("string")).otherwise(name).alias("frequency"),
        iso_text(F.col("a")).alias("min_date"), iso_text(F.col("b")).alias("max_date"),
        days.alias("span_days"), F.col("n").alias("number_of_periods"),
    )


def history(
    df: DataFrame, metric: str, date: str, frequency: str = "auto", by: Sequence[str] = ()
) -> DataFrame:
    """Rows ``(*by, frequency, period, period_start, value)``: sums of the usable values.

    Grouped by label and start, so a week across New Year is two rows with one start.
    """
    wanted = frequency_name(frequency)
    _, value = numeric_column(df, metric)
    by, rows = _dated(df, date, value, by)
    rows = rows.filter(is_finite(F.col("v")))
    chosen = _frequency(rows, wanted)
    name = F.lit(chosen) if isinstance(chosen, str) else chosen
    return rows.groupBy(
        *[column(b) for b in by],
        name.alias("frequency"),
        period_label(F.col("ts"), chosen).alias("period"),
        period_start(F.col("ts"), chosen).alias("period_start"),
    ).agg(F.sum("v").alias("value"))


def forecast_metric(
    df: DataFrame,
    metric: str,
    date: str,
    periods: int = 3,
    frequency: str | None = None,
    by: Sequence[str] = (),
    validate: bool = True,
) -> DataFrame:
    """History and straight-line projection, one model per combination of ``by``.

    Rows ``(*by, kind, step, period, value, slope, direction, frequency, historical_count,
    status)`` with kind ``historical`` or ``projected``. The line is fitted over the position of
    each period, so missing periods do not stretch it. A series with fewer than three periods
    raises ``INSUFFICIENT_DATA``; with ``by``, or ``validate=False``, it keeps its history, has
    no projection and says so in ``status``.
    """
    check_range(periods, 1, MAX_HORIZON, "INVALID_PERIODS", "Periods")
    keys = [resolve_column(df, b) for b in by]
    past = history(df, metric, date, frequency or "auto", keys)
    if validate and not keys:
        found = past.limit(MIN_PERIODS).count()
        if found == 0:
            code = "EMPTY_DATASET" if df.isEmpty() else "NO_VALID_DATA"
            raise AnalyticsError(code, "There are no dated numbers to project.")
        if found < MIN_PERIODS:
            raise AnalyticsError("INSUFFICIENT_DATA", f"At least {MIN_PERIODS} periods are needed, found {found}.")
    return project(past, keys, F.lit(periods))


def project(past: DataFrame, keys: Sequence[str], periods: Column) -> DataFrame:
    """The rows of ``forecast_metric`` from those of ``history``, one line per combination of ``keys``; ``periods`` may be an
    expression over the keys."""
    # Windows over aggregated periods only: their number is bounded by the calendar.
    group = [column(b) for b in keys] or [F.lit(1)]
    ordered = Window.partitionBy(*group).orderBy("period_start", "period")
    numbered = past.withColumn("step", F.row_number().over(ordered) - 1)
    series = numbered.groupBy(*[column(b) for b in keys], "frequency").agg(
        F.regr_slope("value", "step").alias("slope"),
        F.regr_intercept("value", "step").alias("intercept"),
        F.count(F.lit(1)).alias("historical_count"),
        F.max("period_start").alias("last_start"),
        # Years, quarters, months and days have one label per start; for weeks any of the two does.
        F.array_sort(F.collect_list(F.struct("step", "period", "value"))).alias("points"),
    )
    enough = F.col("historical_count") >= MIN_PERIODS
    slope = F.when(enough, F.coalesce(F.col("slope"), F.lit(0.0)))
    direction = F.when(F.col("slope") > FLAT_SLOPE, "up").when(F.col("slope") < -FLAT_SLOPE, "down").otherwise("flat")

    frequency_column = F.col("frequency")

    def projected(ahead: Column) -> Column:
        step = F.col("historical_count") - 1 + ahead
        start = shift_period(F.col("last_start"), ahead, frequency_column)
        predicted = half_even(F.col("slope") * step + F.col("intercept"), 4)
        return F.struct(
            F.lit("projected").alias("kind"), step.cast("long").alias("step"),
            future_label(start, frequency_column).alias("period"), predicted.alias("value"),
        )

    past_points = F.transform(
        "points",
        lambda p: F.struct(
            F.lit("historical").alias("kind"), p["step"].cast("long").alias("step"), p["period"].alias("period"),
            p["value"].alias("value"),
        ),
    )
    none = F.filter(past_points, lambda p: F.lit(False))
    future = F.when(enough, F.transform(F.sequence(F.lit(1), periods), projected)).otherwise(none)
    return series.withColumn("slope", slope).select(
        *[column(b) for b in keys],
        F.inline(F.concat(past_points, future)),
        half_even(F.col("slope"), 4).alias("slope"),
        F.when(enough, direction).alias("direction"),
        "frequency",
        "historical_count",
        F.when(enough, "ok").otherwise("INSUFFICIENT_DATA").alias("status"),
    ).orderBy(*[column(b) for b in keys], "step")


def forecast_chart(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, step, period, historical, forecast, type)`` for one combined line.

    The last historical point also appears in the forecast column, so both lines meet.
    """
    is_past = F.col("kind") == "historical"
    anchor = is_past & (F.col("step") == F.col("historical_count") - 1)
    return forecast.select(
        *[column(b) for b in by], "step", "period",
        F.when(is_past, F.col("value")).alias("historical"),
        F.when(~is_past | anchor, F.col("value")).alias("forecast"),
        F.when(is_past, "Historical").otherwise("Projected").alias("type"),
    )
