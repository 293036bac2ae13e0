"""A join for keys of which a few may hold much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The heaviest keys, taken out of the shuffle. With them gone no key is left that holds more
# than 1/1024 of the rows.
HEAVY_KEYS = 1024


def lookup_by_key(rows: DataFrame, table: DataFrame, key: str, weight: str, value: str, spread: Column) -> DataFrame:
    """``rows`` with ``value`` looked up in ``table`` (one row per key), NULL where absent.

    The ``HEAVY_KEYS`` keys with the largest ``weight`` are broadcast, a fixed number of rows.
    Rows they answer then join on a spread-out dummy key, so the shuffle stays even.
    """
    heavy = table.orderBy(F.desc(weight), key).limit(HEAVY_KEYS)
    heavy = heavy.select(F.col(key).alias("_hot"), F.col(value).alias("_hot_value"))
    first = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), "left")
    dummy = F.concat(F.lit("-"), F.xxhash64(spread).cast("string"))
    routed = first.withColumn("_route", F.when(F.col("_hot").isNotNull(), dummy).otherwise(F.col(key)))
    rest = table.select(F.col(key).alias("_route"), F.col(value).alias("_rest_value"))
    found = routed.join(rest, "_route", "left")
    return found.withColumn(value, F.coalesce("_hot_value", "_rest_value")).drop("_hot", "_hot_value", "_rest_value", "_route")
