"""The byte network: gradients, held-out accuracy, windows, and texts without a language."""

import random

import numpy as np
from pyspark.sql import functions as F

from sheafline.llm import language

PARTS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ßer", "üng", "ach", "ei"], "cc": ["ción", "ñar", "os", "ez"]}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(PARTS))
        text = " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 150)))
        rows.append((i, text, lang))
    return rows


def test_windows_cover_every_byte_and_every_filter_place():
    for n in [0, 1, 3, 4, 188, 189, 190, 192, 193, 378, 379, 1000]:
        data = bytes(i % 251 for i in range(n))
        windows = language.cut(data)
        step = language.WINDOW - max(language.WIDTHS) + 1
        seen = set()
        for w, row in enumerate(windows):
            for i in range(language.WINDOW - max(language.WIDTHS) + 1):
                seen.add(w * step + i)
            held = row[row != language.PAD]
            assert bytes(held.astype(np.uint8)) == data[w * step:w * step + len(held)]
        assert set(range(max(0, n - max(language.WIDTHS) + 1))) <= seen


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    net = language.train(rnd.integers(0, 256, (4, language.WINDOW)).astype(np.int16), np.array([0, 1, 0, 1]), ["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rnd.integers(0, 256, (3, language.WINDOW)).astype(np.int16), np.array([0, 1, 1])

    def loss():
        p = net.probabilities(x)
        return -np.log(p[np.arange(3), y]).mean()

    grads = language._gradients(net, x, y)
    for name, g in grads.items():
        flat = np.argsort(-np.abs(g.ravel()))[:3]
        for at in flat:
            place = np.unravel_index(at, g.shape)
            held = net.p[name][place]
            net.p[name][place] = held + 1e-6
            up = loss()
            net.p[name][place] = held - 1e-6
            down = loss()
            net.p[name][place] = held
            assert abs((up - down) / 2e-6 - g[place]) < 1e-4 + 1e-2 * abs(g[place]), name


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(700)
    docs = spark.createDataFrame(rows + [(9000, "ka lo", None), (9001, None, "aa")], "doc_id long, text string, lang string")
    held_out = F.pmod("doc_id", F.lit(4)) == 2
    model = language.fit(docs, held_out)
    assert model.value.languages == ["aa", "bb", "cc"]
    odd = [(-1, None, "aa"), (-2, "", "aa"), (-3, "123 !? 45", "aa"), (None, "ción ñar", "aa"), (-4, "ka" * 60_000, "aa"), (-5, "a", "aa"), (-5, "a", "aa")]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(3)
    got = language.identify(table, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    tested = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 4 == 2 and r["doc_id"] >= 0]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) > 0.97 * len(tested)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (-1, -2, -3)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] == -4] == ["aa"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ka", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), model).count() == 0


def test_rows_without_letters_do_not_thin_the_sample(spark, monkeypatch):
    seen, real = [], language.hash_sample
    monkeypatch.setattr(language, "hash_sample", lambda df, n, rows, order: seen.append((n, real(df, n, rows, order).count())) or df.limit(0))
    docs = spark.range(2000).selectExpr("id AS doc_id", "'x' AS lang", "CASE WHEN id % 10 = 0 THEN concat('word ', id) ELSE '12' END AS text")
    language.fit(docs, rows=100)
    assert seen == [(200, 100)]
