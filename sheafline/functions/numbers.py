"""Number handling: null/NaN unification, guarded parsing, rounding, shares, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the spellings a number may have. Spark's own cast also takes a type suffix
# ('1d'), and this pattern leaves those out.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"

NUMERIC_TYPES = (T.NumericType,)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def nan_to_null(value: Column, dtype: T.DataType) -> Column:
    """Missing is one thing: NaN becomes NULL (a no-op for types without NaN)."""
    return F.nanvl(value, F.lit(None).cast(dtype)) if is_floating(dtype) else value


def parse_number(text: Column) -> Column:
    """Text to DOUBLE; anything that is not a number is NULL."""
    as_double = F.when(F.lower(text).rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    return F.nanvl(as_double, F.lit(None).cast("double"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def half_even(value: Column, digits: int) -> Column:
    """Round half to even, the way the expected results are rounded."""
    return F.bround(value, digits)


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, half_even(part / whole * 100.0, 2)).otherwise(F.lit(0.0))


def display_number(value: Column) -> Column:
    """``1234.5`` -> ``1,234.5``; whole numbers without decimals; missing -> ``N/A``."""
    value = finite_or_null(value.cast("double"))
    two_places = F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")
    return (
        F.when(value.isNull(), "N/A")
        .when(value == F.floor(value), F.format_number(value, 0))
        .otherwise(two_places)
    )


def plain_number(value: Column) -> Column:
    """``68`` -> ``68.0``, ``29.17`` -> ``29.17``: every digit, no thousands separators."""
    digits = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return F.when(finite_or_null(value.cast("double")).isNull(), "None").otherwise(F.regexp_replace(digits, r"\.$", ".0"))
