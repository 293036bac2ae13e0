"""Calendar periods: frequency names, labels, starts, arithmetic and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError

# Frequency names and their long forms.
FREQUENCIES = ("day", "week", "month", "quarter", "year")
FREQUENCY_ALIASES = {
    "daily": "day",
    "weekly": "week",
    "monthly": "month",
    "quarterly": "quarter",
    "yearly": "year",
}
# Widest span in whole days for each automatic frequency; wider spans use years.
AUTO_SPAN_DAYS = {"day": 31, "week": 180, "month": 730, "quarter": 1825}

MICROS_PER_DAY = 86_400_000_000


def frequency_name(frequency: str | None) -> str:
    """Normalise an argument to one of ``FREQUENCIES`` or ``auto``."""
    name = (frequency or "auto").strip().lower()
    name = FREQUENCY_ALIASES.get(name, name)
    if name != "auto" and name not in FREQUENCIES:
        raise AnalyticsError(
            "INVALID_FREQUENCY", f"Unsupported frequency {frequency!r}; use auto or one of {FREQUENCIES}."
        )
    return name


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two timestamps (not calendar-day difference)."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


def frequency_for_span(days: Column) -> Column:
    """Frequency column chosen from a span in days."""
    choice = None
    for name, limit in AUTO_SPAN_DAYS.items():
        choice = F.when(days <= limit, name) if choice is None else choice.when(days <= limit, name)
    return choice.otherwise("year")


def _by_frequency(frequency: str | Column, build) -> Column:
    """``build(name)`` for a known frequency, or a CASE over all of them for a column."""
    if isinstance(frequency, str):
        return build(frequency)
    choice = F.when(frequency == FREQUENCIES[0], build(FREQUENCIES[0]))
    for name in FREQUENCIES[1:]:
        choice = choice.when(frequency == name, build(name))
    return choice


def period_label(ts: Column, frequency: str | Column, week_year: str = "calendar") -> Column:
    """Text label of the period holding ``ts``.

    Week labels combine the calendar year with the ISO week number unless ``week_year="iso"``.
    """

    def build(name: str) -> Column:
        if name == "day":
            return F.date_format(ts, "yyyy-MM-dd")
        if name == "month":
            return F.date_format(ts, "yyyy-MM")
        if name == "year":
            return F.date_format(ts, "yyyy")
        if name == "quarter":
            return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
        year = F.year(ts) if week_year == "calendar" else F.extract(F.lit("YEAROFWEEK"), ts)
        week = F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
        return F.concat(year.cast("string"), F.lit("-W"), week)

    return _by_frequency(frequency, build)


def period_start(ts: Column, frequency: str | Column) -> Column:
    """First day of the period as a DATE (weeks start on Monday)."""
    return _by_frequency(frequency, lambda name: F.to_date(F.date_trunc(name, ts)))


def shift_period(start: Column, steps: Column, frequency: str | Column) -> Column:
    """Start of the period ``steps`` after the one that starts at ``start``."""
    months = {"month": 1, "quarter": 3, "year": 12}

    def build(name: str) -> Column:
        if name == "day":
            return F.date_add(start, steps.cast("int"))
        if name == "week":
            return F.date_add(start, (steps * 7).cast("int"))
        return F.to_date(F.add_months(start, (steps * months[name]).cast("int")))

    return _by_frequency(frequency, build)


def future_label(start: Column, frequency: str | Column) -> Column:
    """Label of a projected period; a projected week carries the year of its Sunday."""
    week_end = F.date_add(start, 6)

    def build(name: str) -> Column:
        if name != "week":
            return period_label(start, name)
        week = F.lpad(F.weekofyear(start).cast("string"), 2, "0")
        return F.concat(F.year(week_end).cast("string"), F.lit("-W"), week)

    return _by_frequency(frequency, build)


def iso_text(ts: Column) -> Column:
    """ISO text; microseconds appear only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    precise = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(precise.endswith(".000000"), whole).otherwise(precise)


def display_period(label: Column) -> Column:
    """``2026-01`` -> ``Jan 2026``; every other label stays as it is."""
    trimmed = F.trim(label)
    is_month = trimmed.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    # The inner CASE keeps other labels away from the date parser.
    as_date = F.to_date(F.when(is_month, F.concat(trimmed, F.lit("-01"))), "yyyy-MM-dd")
    shown = F.concat(F.date_format(as_date, "MMM"), F.lit(" "), F.year(as_date).cast("string"))
    return F.when(is_month, shown).otherwise(label)
