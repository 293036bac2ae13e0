"""The toxicity model: its probabilities, held-out accuracy, and what it may not read."""

import random

import numpy as np
from pyspark.sql import functions as F

from sheafline.llm import queries, toxicity


def corpus(n, seed=1):
    rnd = random.Random(seed)
    parts = ["ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo", "per", "dan"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[rnd.randrange(len(words))] = rnd.choice(["grumblewart", "Foulmouth", "stinkbrain"])
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(1200)
    held_out = F.pmod("doc_id", F.lit(5)) == 0
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(7, 0, None), (None, 0, 1), (3, 0, 9)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, marks, held_out)
    odd = [(-1, None), (-2, ""), (None, "ka lo mi"), (-3, "!!! ..."), (-4, "ka"), (-4, "ka"), (-5, "x" * 200_000)]
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in docs + odd], "doc_id long, text string, score double").repartition(3)
    got = toxicity.score_documents(rows, model).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    tested = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 0 and r["doc_id"] % 5 == 0]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) > 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (-1, -2, -3)}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(200)
    held_out = F.pmod("doc_id", F.lit(5)) == 0
    table = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, q, 1 - t if i % 5 == 0 else t) for i, q, t in labels]
    scores = []
    for marks in (labels, turned):
        model = toxicity.fit(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), held_out)
        scores.append(sorted(map(tuple, toxicity.score_documents(table, model).collect())))
    assert scores[0] == scores[1]


def test_shared_model_is_a_distribution_and_unknown_words_weigh_alike():
    words = ["abba", "abab", "baab", "bad", "dab"]
    model = toxicity.count_grams(words, np.array([[3, 0], [2, 2], [1, 1], [0, 4], [1, 0]]))
    ratios = dict(zip(words + ["zzz"], toxicity.word_ratios(model, words + ["zzz"])))
    assert ratios["bad"] > 0.3 > abs(ratios["zzz"]) and ratios["abba"] < 0
    whole = toxicity.count_grams(["ab"] * 3, np.ones((3, 2)))
    assert abs(toxicity.word_ratios(whole, ["ab"])[0]) < 1e-9


def test_labels_of_one_class_or_none(spark):
    docs, labels = corpus(40)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    for marks, want in (([], 0.0), ([r for r in labels if r[2] == 0], 0.0), ([r for r in labels if r[2] == 1], 1.0)):
        model = toxicity.fit(table, spark.createDataFrame(marks, schema))
        assert {r["score"] for r in toxicity.score_documents(table, model).collect()} == {want}
    empty = table.limit(0)
    assert toxicity.score_documents(empty, toxicity.fit(empty, spark.createDataFrame([], schema))).count() == 0


def test_query_folds(spark, tmp_path):
    docs, labels = corpus(60)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    import zlib

    for r in queries.QUERIES["op2_toxicity"](spark, str(tmp_path)).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
