"""Column look-up and coercion rules shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.errors import AnalyticsError
from sheafline.functions.numbers import is_numeric, nan_to_null, parse_number

# The date spellings that are recognised, in order, with the format of each.
# A slash or dash date is read month first unless its first number cannot be a month.
DATE_SHAPES = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}", "yyyy-M-d H:mm"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}", "yyyy-M-d H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-M-d H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}", "yyyy-M-d'T'H:mm"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}", "yyyy-M-d'T'H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}Z", "yyyy-M-d'T'H:mm:ss'Z'"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-M-d'T'H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"(0?[1-9]|1[0-2])/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"(0?[1-9]|1[0-2])-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"\d{4}-\d{2}", "yyyy-MM"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{4}", "yyyy"),
)


def column(name: str) -> Column:
    """A top-level column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_column(df: DataFrame, name: str) -> str:
    """Exact name first, then the first case-insensitive match."""
    if name in df.columns:
        return name
    for candidate in df.columns:
        if candidate.lower() == str(name).lower():
            return candidate
    raise AnalyticsError("INVALID_COLUMN", f"No column {name!r}; available: {df.columns}")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    # By position: schema look-up by name would trip over dots and case.
    return df.schema.fields[df.columns.index(name)].dataType


def missing_as_null(df: DataFrame) -> DataFrame:
    """Every floating column with NaN turned into NULL; nothing to do for other columns."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    return df.select([nan_to_null(column(n), t).alias(n) for n, t in fields.items()])


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_timestamp(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def as_number(df: DataFrame, name: str) -> Column | None:
    """The column as DOUBLE with NaN as NULL, or None for types that are never numbers."""
    dtype = dtype_of(df, name)
    if is_numeric(dtype):
        return nan_to_null(column(name), dtype).cast("double")
    if isinstance(dtype, T.BooleanType):
        return column(name).cast("int").cast("double")
    return parse_number(column(name)) if is_text(dtype) else None


def numeric_column(df: DataFrame, name: str, min_parse_ratio: float = 0.7) -> tuple[str, Column]:
    """Resolved name and DOUBLE expression of a numeric column.

    Typed columns cost nothing; a text column costs one small aggregate that checks how many of
    its values are numbers.
    """
    name = resolve_column(df, name)
    value = as_number(df, name)
    if value is not None and is_text(dtype_of(df, name)):
        parsed, present = df.agg(F.count(value), F.count(column(name))).first()
        if not present or parsed / present < min_parse_ratio:
            value = None
    if value is None:
        raise AnalyticsError("NON_NUMERIC_COLUMN", f"Column {name!r} is not numeric.")
    return name, value


def _date_choices(seen: list[int]) -> list[int]:
    """Numbers of the shapes a column is read by, in order, from how many values fit each shape.

    A date with slashes (or dashes) is read month first where every such value of the column can be; where one cannot,
    the day comes first for all, and the month only where the day cannot.
    """
    formats = [fmt for _, fmt in DATE_SHAPES]
    chosen = [i for i, n in enumerate(seen) if n]
    for month_first, day_first in (("M/d/yyyy", "d/M/yyyy"), ("M-d-yyyy", "d-M-yyyy")):
        m, d = formats.index(month_first), formats.index(day_first)
        if seen[m] and seen[m] == seen[d]:
            chosen.remove(d)
        elif seen[m]:
            first, second = chosen.index(m), chosen.index(d)
            chosen[first], chosen[second] = d, m
    return chosen


def read_dates(text: Column, choices: Sequence[int]) -> Column:
    """Timestamp of a text by the chosen shapes, NULL where none fits."""
    trimmed = F.trim(text)
    if len(choices) == 1:
        return F.try_to_timestamp(trimmed, F.lit(DATE_SHAPES[choices[0]][1]))
    tries = [F.when(trimmed.rlike(f"^(?:{shape})$"), F.try_to_timestamp(trimmed, F.lit(fmt)))
             for shape, fmt in (DATE_SHAPES[i] for i in choices)]
    return F.coalesce(*tries)


def date_readings(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """For each text column in which some value looks like a date, the expression that reads it (one aggregate over whole
    columns, so the reading does not depend on which rows come first)."""
    if not names:
        return {}
    fits = [F.array(*[F.count_if(F.trim(column(c)).rlike(f"^(?:{shape})$")) for shape, _ in DATE_SHAPES]).alias(f"c{i}")
            for i, c in enumerate(names)]
    counted = df.agg(*fits).first()
    return {c: read_dates(column(c), _date_choices(list(seen))) for c, seen in zip(names, counted) if any(seen)}


def date_counts(df: DataFrame, name: str) -> DataFrame:
    """One row ``(present, read, unread)``: how many values of a date column there are and can be read."""
    name, when = datetime_column(df, name)
    present, read = F.count(column(name)), F.count(when)
    return df.agg(present.alias("present"), read.alias("read"), (present - read).alias("unread"))


def datetime_column(df: DataFrame, name: str) -> tuple[str, Column]:
    """Resolved name and timestamp expression of a date column.

    A text column is read by every spelling that occurs in it (see ``date_readings``); values in no known spelling are NULL
    and counted by ``date_counts``. Numbers are never dates.
    """
    name = resolve_column(df, name)
    dtype = dtype_of(df, name)
    if isinstance(dtype, T.DateType):
        return name, column(name).cast("timestamp_ntz")
    if is_timestamp(dtype):
        return name, column(name)
    if is_text(dtype):
        found = date_readings(df, [name])
        if found:
            return name, found[name]
        if df.filter(column(name).isNotNull()).isEmpty():
            return name, F.lit(None).cast("timestamp")
    raise AnalyticsError("INVALID_DATETIME_COLUMN", f"Column {name!r} cannot be read as dates.")
