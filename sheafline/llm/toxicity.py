"""Toxicity by class-conditional Kneser-Ney models.

Two character models give each word the probability of its letters (word ends included), one as in toxic text and one as in
ordinary text. Each class counts the longest grams only; what it has seldom seen it takes from one Kneser-Ney model of both
classes together (continuation counts of all shorter grams), so a rare expression weighs alike in both and only repeated
evidence sets them apart. A document's figures are the difference of its two log-likelihoods per word, and the part
of it that single words stand out by, over the square root of their number; a logistic curve, fitted on labelled rows kept
out of the counts, makes them a score.

Counting is a Spark aggregation over labelled rows (distinct words per document, then documents per word and class); scoring
reads each document where it lies, remembers words per task and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm.common import give_back, hash_sample, stored, texts

# Labelled rows a model is fitted on, at most, ordinary and toxic: those with the least hash of their id.
ORDINARY_ROWS, TOXIC_ROWS = 10_000, 5_000
# Of the sample, one row in this many sets the curve instead of the counts.
CURVE_FOLD = 4
# Characters of a gram.
ORDER = 6
DISCOUNT = 0.75
# Occurrences that the shared model counts for in every context of a class.
STRENGTH = 20.0
# Ratios of a word above which it speaks for toxic text by itself.
EXCESS = (2.0, 3.0)
START, END = 1, 2
REMEMBERED = 200_000
LEARNED_AT_ONCE = 50_000
WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Letters:
    """Words as one row of code points, each word between a start and an end mark."""

    codes: np.ndarray
    place: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Letters:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        joined = "".join(f"{chr(START)}{w}{chr(END)}" for w in words)
        owner = np.repeat(np.arange(len(words)), lengths + 2)
        first = np.cumsum(lengths + 2) - lengths - 2
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        return cls(codes, np.arange(len(owner)) - first[owner], owner)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` characters that end at each place; 0 where the word holds fewer up to there."""
        out = np.zeros(len(self.codes), dtype=np.uint64)
        size = len(self.codes) - n + 1
        if size > 0:
            mixed = np.full(size, n, dtype=np.uint64)
            for k in range(n):
                mixed = (mixed ^ self.codes[k:size + k]) * _MIX
                mixed ^= mixed >> np.uint64(29)
            out[n - 1:] = np.where(self.place[n - 1:] >= n - 1, mixed | np.uint64(1), np.uint64(0))
        return out


class Counts:
    """Sorted gram hashes with a row of values each; zeros for grams that are not held."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, at = np.unique(keys, return_inverse=True)
        self.values = np.stack([np.bincount(at, v, minlength=len(self.keys)) for v in values.T], axis=1).astype(np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.values[at], np.float32(0))


@dataclass
class ToxicityModel:
    """Shared gram counts and context totals by order, those of the two classes, and the curve (weights of the figures, then
    the constant). ``curve`` is none when labels of one class are missing; then every score is ``prior``."""

    grams: dict[int, Counts] = field(default_factory=dict)
    contexts: dict[int, Counts] = field(default_factory=dict)
    class_grams: Counts | None = None
    class_contexts: Counts | None = None
    alphabet: int = 256
    curve: list[float] | None = None
    prior: float = 0.0


@dataclass
class FittedToxicity:
    """The gram tables, broadcast, and beside them what a plan needs of the model, so that the driver holds no tables."""

    tables: Broadcast
    curve: list[float] | None
    prior: float


def _full(letters: Letters, now: np.ndarray, n: int) -> np.ndarray:
    """Places whose longest gram is the one of ``n`` characters: of the full order, or back to the start of the word."""
    return (now > 0) & (letters.place > 0) & ((letters.place == n - 1) | (n == ORDER))


def _distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts of several columns laid together, one row for each value of the first."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    _, at = np.unique(columns[0], return_index=True)
    return tuple(c[at] for c in columns)


def count_grams(words: list[str], counts: np.ndarray) -> ToxicityModel:
    """Gram tables from distinct words and their counts per class (columns ordinary, toxic), a block of words at a time."""
    kinds: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}  # grams with the shorter grams they end and begin with
    whole: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}  # full grams with their counts
    codes = {START, END}
    for at in range(0, len(words), LEARNED_AT_ONCE):
        letters = Letters.of(words[at:at + LEARNED_AT_ONCE])
        weight = counts[at:at + LEARNED_AT_ONCE].astype(np.float64)[letters.owner]
        codes.update(np.unique(letters.codes).tolist())
        shorter, now = np.zeros(len(letters.codes), dtype=np.uint64), letters.grams(1)
        for n in range(1, ORDER + 1):
            there, full = (now > 0) & (letters.place > 0), _full(letters, now, n)  # the start mark is never predicted
            begin = np.concatenate([np.zeros(1, dtype=np.uint64), shorter[:-1]])
            kinds[n].append(_distinct([(now[there], shorter[there], begin[there])]))
            held = Counts(now[full], weight[full])
            context = begin[full][np.unique(now[full], return_index=True)[1]]
            whole[n].append((held.keys, held.values, context))
            shorter, now = now, letters.grams(n + 1) if n < ORDER else now
    model = ToxicityModel(alphabet=256 + len(codes))
    keys, values, contexts = [], [], []
    merged = {n: _distinct(parts) for n, parts in kinds.items()}
    for n in range(1, ORDER + 1):
        full_keys, full_values, full_contexts = (np.concatenate(c) for c in zip(*whole[n]))
        # Continuation counts: how many different grams, one character longer, end in this one. Full grams have none longer
        # and keep their plain counts.
        ends = merged[n + 1][1] if n < ORDER else np.zeros(0, dtype=np.uint64)
        model.grams[n] = Counts(np.concatenate([ends, full_keys]), np.concatenate([np.ones(len(ends)), full_values.sum(axis=1)])[:, None])
        if n > 1:
            held = model.grams[n](merged[n][0])
            model.contexts[n] = Counts(merged[n][2], np.concatenate([held, held > 0], axis=1))
            keys.append(full_keys)
            values.append(full_values)
            contexts.append(full_contexts)
    keys, contexts = np.concatenate(keys), np.concatenate(contexts)
    model.class_grams = Counts(keys, np.concatenate(values))
    keys, contexts = _distinct([(keys, contexts)])
    held = model.class_grams(keys)
    model.class_contexts = Counts(contexts, np.concatenate([held, held > 0], axis=1))
    return model


def word_ratios(model: ToxicityModel, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word as toxic less that as ordinary."""
    letters = Letters.of(words)
    at = np.nonzero(letters.place > 0)[0]
    before = letters.grams(1)
    p = (model.grams[1](before[at])[:, 0] + 0.5) / (max(model.grams[1].values.sum(), 1.0) + 0.5 * model.alphabet)
    longest, context = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for n in range(2, ORDER + 1):
        now = letters.grams(n)
        seen, (total, kinds) = model.grams[n](now[at])[:, 0], model.contexts[n](before[at - 1]).T
        p = np.where(total > 0, (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p)
        full = _full(letters, now, n)[at]
        longest[full], context[full] = now[at][full], before[at - 1][full]
        before = now
    total, kinds = np.split(model.class_contexts(context), 2, axis=1)
    seen = model.class_grams(longest)
    q = (np.maximum(seen - DISCOUNT, 0) + (DISCOUNT * kinds + STRENGTH) * p[:, None]) / (total + STRENGTH)
    return np.bincount(letters.owner[at], np.log(q[:, 1]) - np.log(q[:, 0]), minlength=len(words))


class Ratios(dict):
    """Words to their ratios, learned for a batch of texts at once and remembered."""

    def __init__(self, model: ToxicityModel):
        self.model = model

    def learn(self, found: list[list[str]]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        new = [w for w in dict.fromkeys(w for words in found for w in words) if w not in self]
        for at in range(0, len(new), LEARNED_AT_ONCE):
            part = new[at:at + LEARNED_AT_ONCE]
            self.update(zip(part, word_ratios(self.model, part).tolist()))


def figures_of(ratios: Ratios, words: list[str]) -> tuple[float, ...]:
    """The mean ratio of a word, and how far the ratios of the distinct words rise above each of ``EXCESS``, over the square
    root of their number."""
    if not words:
        return (0.0,) * (1 + len(EXCESS))
    kinds = np.array([ratios[w] for w in set(words)])
    return sum(map(ratios.__getitem__, words)) / len(words), *(float(np.maximum(kinds - e, 0).sum()) / len(kinds) ** 0.5 for e in EXCESS)


def figures(text: Column, held: Broadcast) -> Column:
    """The figures of a text as an array of doubles."""

    @F.pandas_udf("array<double>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratios = Ratios(held.value)
        for batch in batches:
            out = []
            for at in range(0, len(batch), 256):
                found = [WORDS.findall(t.lower()) for t in batch.iloc[at:at + 256]]
                ratios.learn(found)
                out += [figures_of(ratios, words) for words in found]
            yield pd.Series(out, dtype=object)
        ratios.clear()
        give_back()

    return made(F.coalesce(text.cast("string"), F.lit("")))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge; figures are scaled to unit spread first."""
    spread = np.maximum(x.std(axis=0), 1e-9)
    z = np.concatenate([x / spread, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    weight = weight / weight.sum() * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + 0.1 * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return [*(w[:-1] / spread).tolist(), float(w[-1])]


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, ordinary_rows: int = ORDINARY_ROWS,
        toxic_rows: int = TOXIC_ROWS) -> FittedToxicity:
    """The model of ``labels.toxic`` (0 or 1 by ``doc_id``) on the texts of ``docs``, its tables broadcast.

    Rows for which ``held_out`` (a condition on ``doc_id``) is true are never read for it. At most ``ordinary_rows`` and
    ``toxic_rows`` labelled documents are used, chosen by a hash of their id; that bounds the words that reach the driver
    and the model. Labels other than 0 and 1 are passed over; of several labels of one id the largest counts; of several
    texts of one id the least is used. Without labels of both classes the score of every text is the share of
    toxic labels (0 without any).
    """
    spark: SparkSession = docs.sparkSession
    learned = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if held_out is not None:
        learned = learned.where(~held_out)
    learned = learned.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in learned.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ordinary, toxic = (hash_sample(learned.where(F.col("toxic") == y), size.get(y, 0), n, F.xxhash64("doc_id", F.lit("sample")))
                       for y, n in ((0, ordinary_rows), (1, toxic_rows)))
    chosen = ordinary.unionAll(toxic)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = stored(rows.withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CURVE_FOLD)) == 0), "labelled")
    model = ToxicityModel(prior=size.get(1, 0) / max(1, sum(size.values())))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    counted = sample.where("NOT curve").select("toxic", F.explode(words).alias("word")).groupBy("word").agg(
        F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.stack([counted["ordinary"].to_numpy(), counted["toxic"].to_numpy()], axis=1) if len(counted) else np.zeros((0, 2))
    if not (counts.sum(axis=0) > 0).all():
        return _shared(spark, model)
    model = replace(count_grams(counted["word"].to_pylist(), counts), prior=model.prior)
    del counted, counts
    grams = spark.sparkContext.broadcast(model)
    shown = sample.where("curve").select("toxic", figures(F.col("text"), grams).alias("x")).collect()
    grams.destroy()  # its copy in the driver's memory is not needed any more
    y = np.array([r["toxic"] for r in shown], dtype=float)
    if len(set(y.tolist())) == 2:
        # The sample takes as many of each class as it can; the curve weighs them as they occur.
        weight = np.where(y == 1, size[1] / max(1, (y == 1).sum()), size[0] / max(1, (y == 0).sum()))
        model.curve = _fit_curve(np.array([r["x"] for r in shown]), y, weight)
    return _shared(spark, model)


def _shared(spark: SparkSession, model: ToxicityModel) -> FittedToxicity:
    held = FittedToxicity(spark.sparkContext.broadcast(model), model.curve, model.prior)
    give_back()
    return held


def toxicity(text: Column, held: FittedToxicity) -> Column:
    """Score of a text from 0 to 1, higher where toxic is likelier."""
    curve = held.curve
    if curve is None:
        return F.lit(float(held.prior))
    x = figures(text, held.tables)
    z = F.aggregate(F.zip_with(x, F.array(*[F.lit(w) for w in curve[:-1]]), lambda a, b: a * b), F.lit(curve[-1]), lambda a, b: a + b)
    return 1 / (1 + F.exp(-z))


def score_documents(docs: DataFrame, held: FittedToxicity, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; predicted is 1 from ``threshold`` on.

    A null or empty text, or one without words, has figures of zero and the score the curve gives them. A null id stays
    null, repeated rows come back each, an empty table gives no rows, other columns are not looked at.
    """
    scored = texts(docs, id_column, text_column).select("doc_id", toxicity(F.col("text"), held).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
