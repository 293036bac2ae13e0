"""Which columns are identifiers rather than metrics."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.operators.columns import column, dtype_of

# Name patterns of identifier columns, matched anywhere in the lower-cased name.
IDENTIFIER_NAMES = (
    r"^id$", r"^id[_\s]", r"[_\s]id$", r"identifier", r"uuid", r"guid", r"^pk$", r"index", r"row[_\s]?num",
)
MIN_SEQUENCE = 5
# How a whole number is written.
WHOLE_TEXT = r"^\s*[+-]?\d{1,19}\s*$"


def has_identifier_name(name: str) -> bool:
    lowered = name.strip().lower()
    return any(re.search(pattern, lowered) for pattern in IDENTIFIER_NAMES)


def identifier_columns(df: DataFrame, names: Iterable[str] | None = None, read_texts: bool = False) -> list[str]:
    """Columns named like identifiers, and integer columns that are one gap-free run.

    A run needs at least five values, none missing, all different, and a range of exactly that
    many integers. The range test is one aggregate over all integer columns. Columns that pass it are checked for repeats together,
    by one bitmap per 32,768 neighbouring integers, so no value is shuffled as itself. ``read_texts`` takes texts that are all whole
    numbers for integers.
    """
    names = list(df.columns if names is None else names)
    by_name = {c for c in names if has_identifier_name(c)}
    integers = {c: column(c).cast("long") for c in names if c not in by_name and isinstance(dtype_of(df, c), T.IntegralType)}
    if read_texts:
        integers |= {c: F.when(column(c).rlike(WHOLE_TEXT), F.trim(column(c)).try_cast("long")) for c in names
                     if c not in by_name and isinstance(dtype_of(df, c), T.StringType)}
    runs: set[str] = set()
    if integers:
        spans = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).alias(f"s{i}") for i, v in enumerate(integers.values())],
        ).first()
        dense = {
            c: s for i, c in enumerate(integers)
            if (s := spans[f"s{i}"])["n"] == spans["rows"] >= MIN_SEQUENCE and s["high"] - s["low"] + 1 == s["n"]
        }
        runs = _without_repeats(df, {c: integers[c] - F.lit(s["low"]) + 1 for c, s in dense.items()}, {c: s["n"] for c, s in dense.items()})
    return [c for c in names if c in by_name or c in runs]


def _without_repeats(df: DataFrame, values: dict[str, Column], numbers: dict[str, int]) -> set[str]:
    """Which columns hold as many different values, counted from 1, as the ``numbers`` of them."""
    if not values:
        return set()
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values.values())])).alias("c"))
    maps = cells.groupBy("c.i", F.bitmap_bucket_number("c.v").alias("b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("c.v"))).alias("n"))
    found = {r["i"]: r["n"] for r in maps.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row per column
    return {c for i, c in enumerate(values) if found[i] == numbers[c]}
