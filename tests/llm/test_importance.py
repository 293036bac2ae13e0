"""Checksums against zlib, and the draw against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from sheafline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text, order, buckets):
    words = WORD.findall(lowered(text))
    runs = [" ".join(words[i:i + m]) for m in range(1, order + 1) for i in range(len(words) - m + 1)]
    return words, [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(rows, target, percent, order, buckets, seed, least_words):
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in plain_features(text, order, buckets)[1]:
            s[b] += 1
    for text in target:
        for b in plain_features(text, order, buckets)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, found = plain_features(text, order, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words)])
    held = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    for rank, row in enumerate(held[:percent * len(held) // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def random_texts(rnd, n):
    letters = "abcXYZ019 -_./\t\n\x7f\x00éÉß世界😀 "
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))) for _ in range(n)]


def check(spark, rows, target, **options):
    options = {"percent": 30, "order": 1, "buckets": 50, "seed": 7, "least_words": 3} | options
    docs = spark.createDataFrame([(i, t, 1, 2, 3.0, "x") for i, t in rows],
                                 "doc_id long, text string, rank int, score int, weight double, `a.b` string").repartition(3)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    got = sorted(map(tuple, importance.resample(docs, wanted, **options).collect()), key=repr)
    assert got == plain(rows, target, **options)


def test_checksums_of_spans_of_every_length_match_zlib():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 5000, dtype=np.uint8)
    lengths = np.concatenate([np.arange(1, 1100), [2048, 2049, 4999, 5000]])
    starts = np.array([rnd.integers(0, 5001 - n) for n in lengths])
    want = [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert importance.crc_of_spans(data, starts, lengths).tolist() == want
    assert importance.crc_of_spans(data, starts[:0], lengths[:0]).tolist() == []


def test_features_of_small_blocks_are_those_of_whole_texts(monkeypatch):
    texts = [*random_texts(random.Random(2), 60), "", None, "word " * 400, "x" * 900, " . " * 200, "a" * 300 + " b c " + "d" * 300, "é" * 500 + " end"]
    for block in (16, 64, 1 << 20):
        monkeypatch.setattr(importance, "BLOCK", block)
        for order in (1, 2, 4):
            got = [[] for _ in texts]
            for rows, found in importance.features(pa.array([t or "" for t in texts]), order, 997):
                for row, bucket in zip(rows.tolist(), found.tolist()):
                    got[row].append(bucket)
            assert [sorted(g) for g in got] == [sorted(plain_features(t, order, 997)[1]) for t in texts]


def test_slices_of_a_batch():
    batch = pa.array(["aa bb", "cc", "dd ee ff"]).slice(1, 2)
    assert sorted(r for rows, _ in importance.features(batch, 1, 10) for r in rows.tolist()) == [0, 1, 1, 1]


def test_the_draw_matches_a_plain_version(spark):
    rnd = random.Random(3)
    rows = list(enumerate(random_texts(rnd, 300)))
    check(spark, rows, random_texts(rnd, 9))
    check(spark, rows[:80], random_texts(rnd, 9), order=3, buckets=997, least_words=5)


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [(1, None), (2, ""), (None, "a b c d"), (3, "A b C d"), (3, "A b C d"), (3, "a b c d e"), (4, "z " * 50_000), (5, "y" * 100_000),
            (-6, "é è ê"), (7, ". , !")]
    check(spark, rows, ["a b", None, ""], percent=100)
    check(spark, rows, [], percent=50)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    got = importance.resample(empty, empty)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.count() == 0


def test_ranks_run_over_all_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 as v").repartition(11)
    held = importance.ranked(rows, [rows["v"].desc(), rows["id"].asc()]).orderBy("rank").collect()
    assert [r["rank"] for r in held] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in held] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
