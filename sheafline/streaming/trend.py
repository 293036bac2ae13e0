"""Incremental period totals over an event stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sheafline.errors import AnalyticsError
from sheafline.functions.dates import period_label, period_start, shift_period
from sheafline.functions.numbers import half_even
from sheafline.operators.aggregate import aggregation_name
from sheafline.operators.columns import as_number, column, resolve_column

# Windows of a fixed length, and calendar periods whose length varies.
WINDOWS = {"day": "1 day", "week": "1 week"}
PERIODS = ("month", "quarter", "year")
# The epoch was a Thursday: weeks that start on Monday begin four days later.
WEEK_OFFSET = "4 days"
#: Timers need a state store that keeps them.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = ("total", "number", "least", "most")


def _parts(value: Column) -> list[Column]:
    """What every aggregation can be put together from, also across windows."""
    return [F.sum(value).alias("total"), F.count(value).alias("number"), F.min(value).alias("least"), F.max(value).alias("most")]


def _value(operation: str) -> Column:
    return {
        "sum": F.coalesce("total", F.lit(0.0)), "mean": half_even(F.col("total") / F.nullif("number", F.lit(0)), 4),
        "count": F.col("number").cast("double"), "min": F.col("least"), "max": F.col("most"),
    }[operation].cast("double")


class _PeriodTotals(StatefulProcessor):
    """Adds up the final days of one calendar period; a timer at the period's end hands the totals on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "total double, number long, least double, most double, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, number, least, most, ends = self.state.get() if self.state.exists() else (None, 0, None, None, None)
        for batch in rows:
            number += int(batch["number"].sum())
            for value in batch["total"].dropna():
                total = value if total is None else total + value
            for value in batch["least"].dropna():
                least = value if least is None else min(least, value)
            for value in batch["most"].dropna():
                most = value if most is None else max(most, value)
            if ends is None:
                ends = int(batch["ends"].iloc[0])
                self.handle.registerTimer(ends)
        self.state.update((total, number, least, most, ends))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            total, number, least, most, _ = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "total": [total], "number": [number], "least": [least], "most": [most]})

    def close(self) -> None:
        pass


def stream_trend(events: DataFrame, date: str, metric: str, aggregation: str = "sum", frequency: str = "day",
                 lateness: str = "2 hours", by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, period, value)``, each emitted once its period is past the watermark.

    For append mode. Rows later than ``lateness`` are dropped, and the newest period is held back
    until the watermark passes its end. Days and weeks are windows. Months, quarters and years add up days that are final: one row per
    key and day reaches the state of a period, whose timer goes off at its end. That state needs the RocksDB provider, which is
    set for the session where no other is.
    """
    operation = aggregation_name(aggregation)
    if frequency not in (*WINDOWS, *PERIODS):
        raise AnalyticsError("INVALID_FREQUENCY", f"A stream is grouped by one of {(*WINDOWS, *PERIODS)}.")
    keys = [resolve_column(events, b) for b in by]
    value = as_number(events, resolve_column(events, metric))
    rows = events.select(
        *[column(b) for b in keys], column(resolve_column(events, date)).cast("timestamp").alias("ts"), value.alias("v")
    ).withWatermark("ts", lateness)
    length = WINDOWS.get(frequency, "1 day")
    window = F.window("ts", length, length, WEEK_OFFSET) if frequency == "week" else F.window("ts", length)
    totals = rows.groupBy(window.alias("w"), *[column(b) for b in keys]).agg(*_parts(F.col("v")))
    if frequency in WINDOWS:
        return totals.select(*[column(b) for b in keys], period_label(F.col("w.start"), frequency).alias("period"), _value(operation).alias("value"))

    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    start = period_start(F.col("w.start"), frequency)
    ends = F.unix_millis(shift_period(start, F.lit(1), frequency).cast("timestamp"))
    names = [F.struct(*[column(b) for b in keys]).alias("by")] if keys else []
    # One text column as key: the period and the values of ``by``, which come back from it.
    key = F.struct(period_label(F.col("w.start"), frequency).alias("period"), *names)
    days = totals.select(F.to_json(key).alias("key"), F.window_time("w").alias("ts"), ends.alias("ends"), *PARTS)
    found = days.groupBy("key").transformWithStateInPandas(
        _PeriodTotals(), "key string, total double, number long, least double, most double", "Append", "EventTime")
    kinds = "".join(f", by STRUCT<{', '.join(f'`{b}`: {events.schema[b].dataType.simpleString()}' for b in keys)}>" if keys else "")
    told = found.withColumn("_k", F.from_json("key", f"period STRING{kinds}"))
    return told.select(*[F.col("_k.by")[b].alias(b) for b in keys], F.col("_k.period").alias("period"), _value(operation).alias("value"))
