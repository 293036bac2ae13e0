"""Personal data: fixed patterns, and boosted trees over the spans that generous generators propose.

Generators propose overlapping spans that look at all like an address, a number or a dotted quad. Each span is described by small
whole numbers: its format (digits, groups, marks, checksum) and its context (words before it, its neighbours). Spans that are one
of a fixed pattern's are labelled positive, spans that touch none negative; a Spark aggregation over all texts counts
labels per combination of features (at most ``CELLS``, by the ranges of the features), and that table is what the trees are fitted
on. Its other half sets a threshold per generator at the wanted precision. Applying the trees is one expression per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm import boosting, spans
from sheafline.llm.common import texts

# The patterns of the base kinds. Possessive repeats, and look-behinds in place of retries inside a run, give the
# same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
BYTE = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

GENERATORS = {
    "address_like": r"(?<![^\s@])[^\s@]{1,64}+@[^\s@]{1,255}+",
    "number_like": r"(?<![0-9])(?<![0-9][\x20().-])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,30}+(?![0-9])",
    "local_like": r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "quad_like": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
}
# Words before a span that speak for one kind of data each.
CONTEXT = (r"(?i)\b(phone|tel|call|mobile|fax)\b", r"(?i)\b(mail|e-mail|email|contact)\b", r"(?i)\b(card|visa|pay|account|iban)\b",
           r"(?i)\b(ip|host|server|address)\b", r"(?i)\b(ssn|id|passport|no)\b")
# Upper ends of the features, each from 0: generator, digits, groups of digits, plus, bracket, host, checksum, bytes, context, before,
# after.
FEATURES = {"generator": 3, "digits": 20, "groups": 6, "plus": 1, "bracket": 1, "host": 1, "checksum": 1, "bytes": 1, "context": 5,
            "before": 2, "after": 2}
CELLS = math.prod(n + 1 for n in FEATURES.values())
PRECISION, LEAST_CHANCE = 0.98, 0.9


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    size = F.char_length(number)
    digit = lambda i: F.ascii(F.substring(number, i, F.lit(1))) - 48
    twice = lambda i: 2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda sum_, i: sum_ + F.when((size - i) % 2 == 1, twice(i)).otherwise(digit(i)))
    return (size > 0) & (total % 10 == 0)


def all_bytes(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.rlike(BYTE))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; matches that fail their check are dropped and not tried again."""
    some = lambda hit, low, high: F.char_length(digits(hit)).between(low, high)
    return {
        "email": spans.matches(text, EMAIL, unless="@"),
        "ip": F.filter(spans.matches(text, IP), lambda s: all_bytes(s["hit"])),
        "card": F.filter(spans.matches(text, CARD), lambda s: luhn(digits(s["hit"]))),
        "phone": F.filter(spans.matches(text, PHONE, unless="+"), lambda s: some(s["hit"], 8, 15)),
    }


def _each(found: Column, make, g: int) -> Column:
    return F.transform(found, lambda s: make(g, s))


def proposals(text: Column) -> Column:
    """All generators' spans as ``struct<start, end, hit, g, words, before, after>``."""

    def around(g: int, s: Column) -> Column:
        room = F.least(s["start"], F.lit(24))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(g).alias("g"),
                        F.substring(text, (s["start"] - room + 1).cast("int"), room.cast("int")).alias("words"),
                        F.when(s["start"] > 0, F.substring(text, s["start"].cast("int"), F.lit(1))).otherwise("").alias("before"),
                        F.substring(text, (s["end"] + 1).cast("int"), F.lit(1)).alias("after"))

    made = [_each(spans.matches(text, p, unless="@" if name == "address_like" else None), around, g)
            for g, (name, p) in enumerate(GENERATORS.items())]
    return F.concat(*made)


def features(c: Column) -> list[Column]:
    """The numbers that describe a proposal, in the order of ``FEATURES``."""
    hit, number = c["hit"], digits(c["hit"])
    flag = lambda condition: condition.cast("int")
    near = F.lit(0)
    for i, pattern in reversed(list(enumerate(CONTEXT))):
        near = F.when(c["words"].rlike(pattern), i + 1).otherwise(near)
    neighbour = lambda x: F.when(x.rlike("[0-9]"), 2).when(x.rlike(r"\p{L}"), 1).otherwise(0)
    return [
        c["g"], F.least(F.char_length(number), F.lit(20)), F.least(F.size(F.split(hit, "[^0-9]+")), F.lit(6)),
        flag(F.startswith(hit, F.lit("+")) | (c["before"] == "+")), flag(F.contains(hit, F.lit("("))),
        flag(hit.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]")), flag((F.char_length(number) >= 12) & luhn(number)),
        flag(hit.rlike(r"^[0-9]+(\.[0-9]+){3}$") & all_bytes(hit)), near, neighbour(c["before"]), neighbour(c["after"]),
    ]


@dataclass
class PiiModel:
    """Trees, and for each generator the log-odds from which its spans are taken."""

    trees: boosting.BoostedTrees
    least: list[float]

    def accepts(self, c: Column) -> Column:
        least = F.element_at(F.array(*[F.lit(x) for x in self.least]), c["g"] + 1)
        return self.trees.column([c[name] for name in FEATURES]) >= least


def _described(c: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["g"].alias("g"),
                    *[f.cast("int").alias(name) for name, f in zip(FEATURES, features(c))])


def _touches(c: Column, held: Column) -> Column:
    return F.exists(held, lambda h: (h["start"] < c["end"]) & (c["start"] < h["end"]))


def labelled_cells(docs: DataFrame) -> DataFrame:
    """Counts of positive and negative proposals by features and half (by a hash of the id) over all texts."""
    base = base_spans(F.col("text"))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).alias("half"), proposals(F.col("text")).alias("found"), F.concat(
        *[F.transform(base[k], lambda s: F.struct(s["start"], s["end"])) for k in KINDS]).alias("base"))
    rows = rows.where(F.size("found") > 0)
    same = lambda c: F.exists("base", lambda h: (h["start"] == c["start"]) & (h["end"] == c["end"]))
    told = F.transform("found", lambda c: F.struct(
        F.when(same(c), 1).when(_touches(c, F.col("base")), -1).otherwise(0).alias("label"), _described(c).alias("c")))
    each = rows.select("half", F.explode(told).alias("x")).where("x.label >= 0")
    return each.groupBy("half", *[F.col(f"x.c.{name}").alias(name) for name in FEATURES]).agg(
        F.sum(F.col("x.label")).alias("positive"), F.sum(1 - F.col("x.label")).alias("negative"))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> PiiModel:
    """Trees from one half of all texts, thresholds from the other: per generator the least chance, ``LEAST_CHANCE`` or more,
    at which spans of that chance or above are positive in ``PRECISION`` of cases; without one the generator adds nothing."""
    cells = labelled_cells(texts(docs, id_column, text_column)).collect()
    cells.sort(key=lambda r: tuple(r))
    x = np.array([[r[name] for name in FEATURES] for r in cells], dtype=np.int64).reshape(len(cells), len(FEATURES))
    half, positive, negative = (np.array([r[name] for r in cells], dtype=float) for name in ("half", "positive", "negative"))
    first = half == 0
    trees = boosting.fit(x[first], positive[first], negative[first])
    odds, least = trees.log_odds(x), []
    floor = math.log(LEAST_CHANCE / (1 - LEAST_CHANCE))
    for g in range(len(GENERATORS)):
        mine = ~first & (x[:, 0] == g) & (odds >= floor)
        chosen = math.inf
        for at in np.unique(odds[mine])[::-1]:
            above = mine & (odds >= at)
            if positive[above].sum() >= PRECISION * (positive[above] + negative[above]).sum():
                chosen = float(at)
        least.append(chosen if math.isfinite(chosen) else 1e9)
    return PiiModel(trees, least)


def find_personal_data(docs: DataFrame, model: PiiModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, base, spans``: ``struct<start, order, kind, end>`` in code points, end exclusive, sorted by kind (base
    kinds first), then start.

    ``base`` holds the fixed kinds only; ``spans`` adds the proposals that the trees accept and no base span touches, named
    after their generator. A null text is the empty text and has none; a null id stays null; repeated rows come back
    each; an empty table gives no rows; other columns are not looked at. Texts are read whole.
    """
    base = base_spans(F.col("text"))
    kept = F.concat(*[spans.of_kind(base[kind], kind, i) for i, kind in enumerate(KINDS)])
    rows = texts(docs, id_column, text_column).select("doc_id", "text", kept.alias("base"), proposals(F.col("text")).alias("found"))
    free = F.filter("found", lambda c: ~_touches(c, F.col("base")))
    taken = F.filter(F.transform(free, _described), model.accepts)
    rows = rows.select("doc_id", "text", "base", taken.alias("taken"))
    by = lambda g: F.filter("taken", lambda c: c["g"] == g)
    added = F.concat(*[spans.of_kind(by(g), name, len(KINDS) + g) for g, name in enumerate(GENERATORS)])
    return rows.select("doc_id", "text", "base", F.concat("base", added).alias("spans"))


def redact(docs: DataFrame, model: PiiModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text``: every run of overlapping spans replaced by ``[PII]``."""
    found = find_personal_data(docs, model, id_column, text_column)
    return found.select("doc_id", spans.masked(F.col("text"), F.array_sort("spans"), "[PII]").alias("text"))
