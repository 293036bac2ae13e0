"""Language of a text by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length that overlap by the widest filter less one. Bytes become small
vectors, filters of several widths run over them, each filter keeps its largest response (max pooling), and a softmax
names the language; a document takes the mean over its windows, weighted by their bytes. The network is trained in numpy
on a bounded sample of labelled windows and applied to all windows of every text, where the text lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import hash_sample, texts

WINDOW = 192
WIDTHS, FILTERS, WIDE = (2, 3, 4), 16, 8
# Labelled documents the network is trained on, at most, and windows of each.
SAMPLE_ROWS, SAMPLE_WINDOWS = 12_000, 3
EPOCHS, STEP, BATCH, SEED = 4, 3e-3, 256, 5
# Windows that run through the network at once.
BLOCK = 512
UNDETERMINED = "und"
PAD = 256


@dataclass
class ByteNetwork:
    """Parameters: byte vectors, filters and biases by width, the last layer; and the languages it tells apart."""

    languages: list[str]
    p: dict[str, np.ndarray]

    def logits(self, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Rows of ``WINDOW`` byte values (``PAD`` after the end) to one figure per language."""
        x = self.p["bytes"][windows]
        pooled = []
        for w in WIDTHS:
            cols = sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * WIDE)
            held = cols @ self.p[f"f{w}"]
            if keep is not None:
                keep[w] = (cols, held.argmax(axis=1))
            pooled.append(np.maximum(held.max(axis=1) + self.p[f"b{w}"], 0))
        h = np.concatenate(pooled, axis=1)
        if keep is not None:
            keep["h"] = h
        return h @ self.p["out"] + self.p["bias"]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.logits(windows)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def cut(data: bytes) -> np.ndarray:
    """All windows of a text, one row each, the last one padded."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.full((n - 1) * step + WINDOW, PAD, dtype=np.int16)
    padded[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return sliding_window_view(padded, WINDOW)[::step]


def train(windows: np.ndarray, target: np.ndarray, languages: list[str]) -> ByteNetwork:
    """Adam on cross-entropy over shuffled batches; gradients by hand."""
    rnd = np.random.default_rng(SEED)
    p = {"bytes": rnd.normal(0, 0.5, (PAD + 1, WIDE)), "bias": np.zeros(len(languages)),
         "out": rnd.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages)))}
    for w in WIDTHS:
        p |= {f"f{w}": rnd.normal(0, 1 / np.sqrt(w * WIDE), (w * WIDE, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    net = ByteNetwork(languages, {k: v.astype(np.float32) for k, v in p.items()})
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            t += 1
            for k, g in _gradients(net, windows[rows], target[rows]).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                net.p[k] -= (STEP * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: ByteNetwork, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    keep: dict = {}
    z = net.logits(windows, keep)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    dz = e / e.sum(axis=1, keepdims=True)
    dz[np.arange(len(dz)), target] -= 1
    dz /= len(dz)
    h = keep["h"]
    out = {"out": h.T @ dz, "bias": dz.sum(axis=0), "bytes": np.zeros_like(net.p["bytes"])}
    dh = (dz @ net.p["out"].T) * (h > 0)
    rows = np.arange(len(windows))
    for i, w in enumerate(WIDTHS):
        cols, best = keep[w]
        d = dh[:, i * FILTERS:(i + 1) * FILTERS]
        at = cols[rows[:, None], best]  # the columns that gave each filter's largest response
        out[f"f{w}"] = np.einsum("bfc,bf->cf", at, d)
        out[f"b{w}"] = d.sum(axis=0)
        back = (d[:, :, None] * net.p[f"f{w}"].T[None]).reshape(len(windows), FILTERS, w, WIDE)
        seen = windows[rows[:, None, None], best[:, :, None] + np.arange(w)]
        np.add.at(out["bytes"], seen.ravel(), back.reshape(-1, WIDE))
    return out


def fit(docs: DataFrame, held_out: Column | None = None, rows: int = SAMPLE_ROWS) -> Broadcast:
    """A network trained on ``text`` and ``lang`` of at most ``rows`` documents, those with the least hash of their id.

    Rows for which ``held_out`` (a condition on ``doc_id``) is true, and rows without text, letters or language, are
    not used. Without any the network is none and every text is undetermined.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    if held_out is not None:
        labelled = labelled.where(~held_out)
    start = lambda k: F.pmod(F.xxhash64("doc_id", k), F.greatest(F.char_length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    cuts = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda k: F.substr("text", start(k), F.lit(WINDOW)))
    order = F.xxhash64("doc_id", "lang", F.lit("sample"))
    chosen = hash_sample(labelled.select("doc_id", "lang", cuts.alias("cuts")), labelled.count(), rows, order)
    sample = sorted(chosen.select("lang", "cuts").collect())
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return spark.sparkContext.broadcast(None)
    pairs = [(cut(c.encode()[:WINDOW])[0], languages.index(r["lang"])) for r in sample for c in dict.fromkeys(r["cuts"])]
    return spark.sparkContext.broadcast(train(np.stack([w for w, _ in pairs]), np.array([y for _, y in pairs]), languages))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def _mean_over_windows(net: ByteNetwork, batch: list[bytes]) -> np.ndarray:
    """Probabilities of each text."""
    total = np.zeros((len(batch), len(net.languages)))
    waiting, owner, weight = [], [], []

    def run() -> None:
        at = np.concatenate(waiting)
        p = net.probabilities(at) * np.concatenate(weight)[:, None]
        np.add.at(total, np.concatenate(owner), p)
        for held in (waiting, owner, weight):
            held.clear()

    size = 0
    for i, data in enumerate(batch):
        windows = cut(data)
        for at in range(0, len(windows), BLOCK):
            part = windows[at:at + BLOCK]
            waiting.append(part)
            owner.append(np.full(len(part), i))
            weight.append((part != PAD).sum(axis=1))
            size += len(part)
            if size >= BLOCK:
                run()
                size = 0
    if size:
        run()
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)


def language(text: Column, held: Broadcast) -> Column:
    """``struct<lang_pred, score>`` of a text; the score is the probability of the language named."""

    @F.pandas_udf("lang_pred string, score double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = held.value
        for batch in batches:
            p = np.concatenate([_mean_over_windows(net, [t.encode() for t in batch.iloc[at:at + 256]]) for at in range(0, len(batch), 256)])
            best = p.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": [net.languages[i] for i in best], "score": p[np.arange(len(p)), best]})

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return nothing if held.value is None else named(text)


def identify(docs: DataFrame, held: Broadcast, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0. A null id stays null, repeated rows come back
    each, an empty table gives no rows; other columns are not looked at.
    """
    rows = texts(docs, id_column, text_column)
    made = rows.withColumn("_made", language(F.col("text"), held)).withColumn("_letter", has_letter(F.col("text")))
    return made.select("doc_id", F.when(F.col("_letter"), F.col("_made.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
                       F.when(F.col("_letter"), F.col("_made.score")).otherwise(0.0).alias("score"))
