"""Personal data against a plain scan of each text."""

import random
import re

from sheafline.llm import boosting, pii, spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    def numbers(m):
        return re.sub("[^0-9]", "", m[0])

    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 16 <= len(numbers(m)) <= 19 and luhn(numbers(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(numbers(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


PARTS = ["a.b", "@", "x@y.com", "@mail", ".org", "1", "12", "255", "256", "007", ".", "-", " ", "  ", "+", "+1 (555) 123-4567", "(", ")", "4111111111111111",
         "4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.1", "é", "😀", "%", "_", "\n", "the", "call", "12345678"]
TEXTS = ["", " ", "a@b@c.com", "x@y.com_z@w.org", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "+1 2", "+12345678", "+1" * 9000, "1 2 " * 9000, "9" * 40_000,
         "a" * 60_000 + "@", "a@b." * 5000, "1." * 20_000, "4111 1111 1111 1111 5", "4111111111111111-", "😀 4111111111111111 +44 20 7946 0958"]


def test_base_spans_match_a_plain_scan(spark):
    rnd = random.Random(11)
    texts = TEXTS + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x@y.com"), (3, None)], "doc_id long, text string").repartition(3)
    model = pii.PiiModel(boosting.BoostedTrees(0.0, []), [1e9] * len(pii.GENERATORS))
    got = pii.find_personal_data(docs, model).select("text", spans.written(spans.F.col("base")).alias("b"),
                                                     spans.written(spans.F.col("spans")).alias("s")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["b"] == base(r["text"]) == r["s"], r["text"][:200]


def test_trees_learn_the_labels_of_the_cells():
    import numpy as np

    x = np.array([[a, b, c] for a in range(4) for b in range(5) for c in range(2)])
    positive = ((x[:, 0] > 1) & (x[:, 1] < 3) | (x[:, 2] == 1) & (x[:, 1] == 4)).astype(float) * 50
    model = boosting.fit(x, positive, 50 - positive)
    assert (((model.log_odds(x)) > 0) == (positive > 0)).all()


def test_trees_are_the_same_as_a_column(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 5, (60, 3))
    positive = (x.sum(axis=1) > 6).astype(float)
    model = boosting.fit(x, positive, 1 - positive)
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int")
    got = [r[0] for r in rows.select(model.column([spans.F.col(n) for n in "abc"])).collect()]
    assert np.allclose(got, model.log_odds(x))


def test_added_spans_touch_no_base_span(spark):
    docs = spark.createDataFrame([(1, "call (555) 123-4567 or +1 555 123 4567, x@y.com, a@b")], "doc_id long, text string")
    taken = pii.PiiModel(boosting.BoostedTrees(1.0, []), [0.0] * len(pii.GENERATORS))
    row = pii.find_personal_data(docs, taken).first()
    kept = [(s["start"], s["end"]) for s in row["base"]]
    added = [s for s in row["spans"] if s["kind"] not in pii.KINDS]
    assert {s["kind"] for s in added} >= {"number_like", "address_like"}
    assert not any(s["start"] < e and b < s["end"] for s in added for b, e in kept)
    assert pii.redact(docs, taken).first()["text"] == "call [PII] or [PII], [PII], [PII]"


def test_fit_on_texts_and_on_an_empty_table(spark):
    rows = [(i, f"mail user{i}@mail.example.com or 10.0.{i % 256}.7 today, see 1234567 and 12-34") for i in range(300)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    out = pii.find_personal_data(spark.createDataFrame(rows[:20], "doc_id long, text string"), model).collect()
    assert all([s["kind"] for s in r["spans"]] == ["email", "ip"] for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert pii.find_personal_data(empty, pii.fit(empty)).count() == 0
