"""Secrets in texts: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models over the characters of tokens are trained on labelled samples: the values that the patterns find
are random strings, other long tokens of the same texts are ordinary ones. A token that holds letters and digits is a secret
when the log-likelihood of its transitions under the first model exceeds that under the second by a margin. Training is a
Spark aggregation over all texts (transitions are counted before the shuffle, 2 x 67 x 67 rows at most reach the driver); scoring is
expressions only, row by row.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm import spans
from sheafline.llm.common import texts

# The patterns of the base kinds and the least lengths that count.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET)
LEAST = 16
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % LEAST
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{%d,}+" % LEAST
# Margin of the log-likelihood ratio, in all and per transition.
MARGIN, MARGIN_EACH = 15.0, 0.6
# Occurrences that the frequency of characters counts for in each row of transitions.
BACKOFF = 10.0
MASK = "[SECRET]"


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind."""
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 1)
    assign = F.filter(spans.matches(text, ASSIGN), lambda s: F.char_length(value(s["hit"])) >= ASSIGN_VALUE)
    return {"assign": assign, "access": spans.matches(text, ACCESS, unless="AKIA"), "hex": spans.matches(text, HEX)}


@dataclass
class SecretModel:
    """``ratios[STATES * a + b]``: log-probability of ``b`` after ``a`` in random strings less that in ordinary ones."""

    ratios: list[float]

    def ratio(self, token: Column) -> Column:
        """Log-likelihood ratio of a token of ``ALPHABET`` characters."""
        held = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")  # folded into a constant
        code = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
        steps = F.sequence(F.lit(1), F.char_length(token) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda sum_, i: sum_ + held[code(i) * STATES + code(i + 1)])


def labelled_tokens(docs: DataFrame) -> DataFrame:
    """``label, token``: 1 for values the patterns found, 0 for other tokens of at least ``LEAST`` characters."""
    text = F.col("text")
    base = base_spans(text)
    values = F.concat(F.transform(base["assign"], lambda s: F.regexp_extract(s["hit"], ASSIGN, 1)),
                      F.transform(base["access"], lambda s: s["hit"]), F.transform(base["hex"], lambda s: s["hit"]))
    rows = docs.select(values.alias("values"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"))
    other = F.filter("tokens", lambda t: ~F.exists("values", lambda v: F.contains(t, v) | F.contains(v, t)))
    both = F.concat(F.transform("values", lambda v: F.struct(F.lit(1).alias("label"), F.regexp_replace(v, r"\.", "").alias("token"))),
                    F.transform(other, lambda t: F.struct(F.lit(0).alias("label"), t.alias("token"))))
    return rows.select(F.explode(both).alias("x")).select("x.label", "x.token")


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> SecretModel:
    """Both Markov models from all texts. Without samples of a kind its model is that of uniformly random characters."""
    tokens = labelled_tokens(texts(docs, id_column, text_column)).where(F.char_length("token") > 1)
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring("token", i, F.lit(1))) - 1
    steps = F.transform(F.sequence(F.lit(1), F.char_length("token") - 1), lambda i: code(i) * STATES + code(i + 1))
    counted = tokens.select("label", F.explode(steps).alias("step")).groupBy("label", "step").agg(F.count("*").alias("n"))
    counts = [[0] * STATES**2, [0] * STATES**2]
    for row in counted.collect():
        counts[row["label"]][row["step"]] = row["n"]
    ordinary, random = map(log_probabilities, counts)
    return SecretModel([round(r - o, 4) for r, o in zip(random, ordinary)])


def log_probabilities(counts: list[int]) -> list[float]:
    """Transition log-probabilities; each row is smoothed by the frequency of the next character, and that by one
    more occurrence of every character."""
    rows = [counts[a * STATES:(a + 1) * STATES] for a in range(STATES)]
    total = sum(counts) + STATES
    often = [(sum(row[b] for row in rows) + 1) / total for b in range(STATES)]
    return [math.log((n + BACKOFF * p) / (sum(row) + BACKOFF)) for row in rows for n, p in zip(row, often)]


def secret_spans(text: Column, model: SecretModel) -> tuple[Column, Column]:
    """Sorted spans of the base kinds, and those that the model adds (kind ``markov``)."""
    base = base_spans(text)
    kept = F.array_sort(F.concat(*[spans.of_kind(base[kind], kind, i) for i, kind in enumerate(KINDS)]))
    random = F.filter(spans.matches(text, MIXED), lambda s: model.ratio(s["hit"]) >= F.greatest(
        F.lit(MARGIN), MARGIN_EACH * (F.char_length(s["hit"]) - 1)))
    return kept, spans.of_kind(random, "markov", len(KINDS))


def find_secrets(docs: DataFrame, model: SecretModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, base, spans``: sorted ``struct<start, order, kind, end>`` in code points, end exclusive.

    ``base`` holds the fixed kinds only; ``spans`` adds what the model finds and no base span touches. A null text is the
    empty text and has none; a null id stays null; repeated rows come back each; an empty table gives no rows; other columns
    are not looked at. Texts are read whole.
    """
    rows = texts(docs, id_column, text_column)
    base, added = secret_spans(F.col("text"), model)
    rows = rows.select("doc_id", "text", base.alias("base"), added.alias("added"))
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", spans.without_overlap(F.col("added"), F.col("base")))).alias("spans"))


def redact(docs: DataFrame, model: SecretModel, text_column: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text_column`` replaced by ``[SECRET]``; null texts stay null, other columns as they are."""
    base, added = secret_spans(F.coalesce(F.col(text_column), F.lit("")), model)
    names = [_free(docs, f"_{name}") for name in ("base", "added")]
    held = docs.withColumns(dict(zip(names, (base, added))))
    found = F.array_sort(F.concat(F.col(names[0]), spans.without_overlap(F.col(names[1]), F.col(names[0]))))
    return held.withColumn(text_column, spans.masked(F.col(text_column), found, MASK)).drop(*names)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name
