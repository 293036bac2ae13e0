"""Removal of repeated windows against a plain scan, and the promise recompression rests on."""

import hashlib
import random

import numpy as np
import pytest

from sheafline.llm import substrings
from sheafline.llm.recompression import recompress


def plain(rows, window):
    """What is left of each row, by looking at every window."""
    first = {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        key = doc_id if doc_id is not None else 2**63 - 1
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(first.get(g, key), key)
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        key = doc_id if doc_id is not None else 2**63 - 1
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < key for p in range(i, i + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "the"]
    line = lambda k: [rnd.choice(words) for _ in range(k)]
    passages = [line(rnd.randint(5, 60)) for _ in range(6)] + [["a"] * 40, ["a", "b"] * 20, ["x", "y", "z"] * 15, ["q"] * 13 + line(12)]
    rows = []
    for i in range(n):
        body = line(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = p[rnd.randint(0, len(p) // 2):][:rnd.randint(1, len(p))]
            body += cut + line(rnd.randint(0, 6))
        rows.append((rnd.randint(0, 10 * n), rnd.choice([" ", "\n", "\t\x0b ", "  "]).join(body)))
    whole = rows[0][1]
    return rows + [(None, whole), (None, None), (5, ""), (6, " \n"), (7, whole), (7, whole), (8, None), (9, "one"), (3, " " + whole + " ")]


@pytest.mark.parametrize(("seed", "window", "least"), [(1, 8, 1), (2, 8, 2), (3, 12, 2), (4, 20, 4), (5, 1, 1), (6, 50, 4)])
def test_removal_matches_a_plain_scan(spark, seed, window, least):
    rows = texts(seed, 60)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, print int").repartition(3)
    got = substrings.remove_repeats(docs, window, least, with_text=True).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, window)


def test_small_parts_give_the_same(spark, monkeypatch):
    rows = texts(9, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.remove_repeats(docs, 8, 2)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == [r[:4] for r in plain(rows, 8)]


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_deciding_words_decide():
    """Wherever the words from ``low`` to ``high`` of a symbol occur again, the symbol does too."""
    rnd = np.random.default_rng(1)
    for _ in range(60):
        words = rnd.integers(0, rnd.integers(2, 30), 80).astype(np.uint64)
        one = recompress(words, np.zeros(80, dtype=np.int64))
        at = rnd.integers(0, 40)
        other = np.concatenate([rnd.integers(0, 30, 25).astype(np.uint64), words[at:at + 40], rnd.integers(0, 30, 25).astype(np.uint64)])
        two = recompress(other, np.zeros(len(other), dtype=np.int64))
        held = set(zip(two.name.tolist(), two.start.tolist()))
        for name, start, low, high in zip(one.name.tolist(), one.start.tolist(), one.low.tolist(), one.high.tolist()):
            if low >= at and high <= at + 40:
                assert (name, start - at + 25) in held
