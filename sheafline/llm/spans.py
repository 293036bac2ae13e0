"""Spans of pattern matches in whole texts, by Spark's own expressions.

A text cut at its matches gives the gaps between them, so gaps and matches laid side by side give every start and end in
code points. All of it stays in the row: nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def matches(text: Column, pattern: str, unless: str | None = None) -> Column:
    """``array<struct<start, end, hit>>`` of the leftmost non-overlapping matches, in order.

    ``pattern`` must not match the empty string. ``unless`` is a plain substring without which there is no match.
    Repeats in patterns should be possessive, so that long texts neither backtrack nor overflow the stack.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def add(held: Column, pair: Column) -> Column:
        start = held["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit")))
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(pair["hit"].isNull(), held["spans"]).otherwise(F.concat(held["spans"], one)).alias("spans"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    found = F.aggregate(pairs, first, add, lambda held: held["spans"])
    there = text.rlike(pattern)
    if unless:
        there = F.contains(text, F.lit(unless)) & there
    return F.when(there, found).otherwise(F.array().cast(SPAN))


def of_kind(spans: Column, kind: str, order: int) -> Column:
    """Spans as ``struct<start, order, kind, end>``; sorting them goes by start, then order."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def without_overlap(spans: Column, held: Column) -> Column:
    """``spans`` that share no character with any of ``held``."""
    return F.filter(spans, lambda s: ~F.exists(held, lambda h: (h["start"] < s["end"]) & (s["start"] < h["end"])))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every run of overlapping ``spans`` (sorted by start) replaced by ``mask``."""

    def add(held: Column, s: Column) -> Column:
        between = F.substring(text, (held["at"] + 1).cast("int"), (s["start"] - held["at"]).cast("int"))
        fresh = s["start"] >= held["at"]
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(held["out"], between, F.lit(mask))).otherwise(held["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda held: F.concat(held["out"], F.substring(text, (held["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, add, rest)).otherwise(text)
