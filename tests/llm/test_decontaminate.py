"""Benchmark passages against a plain comparison of every alignment."""

import itertools
import random
import re

from sheafline.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, items, window=20, share=0.8):
    found = {}
    for doc_id, text in docs:
        w = words(text)
        for item_id, item in items:
            v = words(item)
            need = min(window, len(v))
            if need < 6:
                continue
            best = None
            for shift in range(-len(v), len(w)):
                for s in range(len(v) - need + 1):
                    n = sum(0 <= k + shift < len(w) and w[k + shift] == v[k] for k in range(s, s + need))
                    if n >= -(-need * 4 // 5):
                        best = max(best or (0, 0), (n, -(s + shift)))
            if best:
                found[doc_id, text, item_id] = (best[0], need, -best[1])
    return found


def test_masks_find_any_four_changed_words_in_twenty():
    places = [[i for i, c in enumerate(m) if c == "1"] for m in d.MASKS]
    for changed in itertools.combinations(range(20), 4):
        bad = set(changed)
        assert any(all(s + p not in bad for p in ps) for m, ps in zip(d.MASKS, places) for s in range(20 - len(m) + 1))


def test_passages_match_a_plain_comparison(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)] + ["the", "of", "and"] * 5
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(line(rnd.choice([6, 9, 15, 25, 50])))) for i in range(25)] + [(90, None), (91, ""), (92, "a b c"), (3, " ".join(line(20)))]
    docs = []
    for i in range(120):
        body = line(rnd.randint(0, 80))
        if i % 2:
            passage = words(rnd.choice(items[:25])[1])
            cut = passage[rnd.randint(0, 3):] if rnd.random() < 0.5 else passage
            for _ in range(rnd.randint(0, 6)):
                cut[rnd.randrange(len(cut))] = "changed"
            at = rnd.randint(0, len(body))
            body[at:at] = [w.upper() + rnd.choice(["", "%%%", ",", "\n"]) for w in cut]
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (1, items[4][1]), (1, items[4][1])]
    got = d.find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                          spark.createDataFrame(items, "item_id long, text string"))
    text = {(r["doc_id"], r["h"]): r["text"] for r in spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    rows = got.collect()
    found = {(r["doc_id"], text[r["doc_id"], r["text_hash"]], r["item_id"]): (r["matched"], r["window"], r["start"]) for r in rows}
    assert len(found) == len(rows)
    want = plain(docs, items)
    close = {k for k, v in want.items() if v[1] < 20}  # short items may have every seed broken by their changed words
    assert {k: v for k, v in want.items() if k not in close} == {k: v for k, v in found.items() if k not in close}
    assert set(found) <= set(want) and len(set(found) & close) > 0.9 * len(close)


def test_blocks_give_the_same_rows(spark, monkeypatch):
    rows = [(i, " ".join(f"t{(i * 7 + k) % 50}" for k in range(30))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(rows[:10], "item_id long, text string")
    once = sorted(map(tuple, d.find_passages(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_WORDS", 40)
    assert sorted(map(tuple, d.find_passages(docs, items).collect())) == once and once


def test_removal_keeps_clean_rows_and_columns(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(1, f"x {item} y", 0), (2, "clean text", 1), (None, item, 2), (None, None, 3), (2, item, 4), (5, "", 5), (2, "clean text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    out = d.remove_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(r["item_id"] for r in out.collect()) == [1, 1, 3, 5]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"), "item_id long, text string"
    assert d.find_passages(docs, spark.createDataFrame([], none)).count() == 0
    assert d.find_passages(docs.limit(0), spark.createDataFrame([(1, "a b c d e f g h")], none)).count() == 0


def test_short_items_are_found_under_all_changes(spark):
    items = [(m, " ".join(f"i{m}w{k}" for k in range(m))) for m in range(1, 21)]
    docs = []
    for m, item in items:
        for bad in itertools.combinations(range(m), m - -(-m * 4 // 5)):
            docs.append((len(docs), m, " ".join(["before"] + ["changed" if k in bad else w for k, w in enumerate(item.split())])))
    frame = spark.createDataFrame(docs, "doc_id long, m int, text string").repartition(4)
    got = d.find_passages(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched"], r["window"]) for r in got) == [(i, m, -(-m * 4 // 5), m) for i, m, _ in docs]


def test_short_items_and_scripts_without_spaces_match_a_plain_comparison(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(1 + i % 25))) for i in range(50)]
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    han = "\u6771\u4eac\u90fd\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3042\u308b"
    items, docs = items + [(99, han)], docs + [(99, "\u4eca\u65e5" + han[:5] + "\u5927" + han[6:] + "\u3068"), (98, han[:6])]
    got = d.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for doc_id, text in docs:
        w = list(text) if doc_id > 90 else words(text)
        for item_id, item in items:
            v = list(item) if item_id > 90 else words(item)
            need = min(20, len(v))
            starts = ((s, x) for s in range(len(v) - need + 1) for x in range(-need, len(w)))
            if any(sum(0 <= x + k < len(w) and w[x + k] == v[s + k] for k in range(need)) >= -(-need * 4 // 5) for s, x in starts):
                want.add((doc_id, item_id))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and (99, 99) in want and (98, 99) not in want


def test_hits_of_long_texts_carry_only_the_words_around(spark, monkeypatch):
    rnd = random.Random(7)
    items = [(i, " ".join(f"p{i}x{k}" for k in range(rnd.choice([3, 6, 20, 60])))) for i in range(12)]
    body = []
    for k in range(40):  # passages at and across the ends of segments too
        body += [f"n{rnd.randrange(10**6)}" for _ in range(rnd.randint(20, 90))] + items[k % 12][1].split()
    docs = spark.createDataFrame([(1, " ".join(body)), (2, items[1][1]), (3, "a")], "doc_id long, text string")
    table, sizes, real = spark.createDataFrame(items, "item_id long, text string"), [], d._verified
    monkeypatch.setattr(d, "_verified", lambda hits, *a: sizes.append(hits.selectExpr("max(size(words))", "count(*)").first()) or real(hits, *a))
    once = sorted(map(tuple, d.find_passages(docs, table).collect()))
    assert sizes[0][0] <= 2 * d.WINDOW and sizes[0][1] > 900 and len(body) > 2500
    first = {}
    for i, item in items:
        n, w = min(20, len(item.split())), item.split()
        first[i] = next(at for at in range(len(body)) if body[at:at + n] == w[:n])
    assert {r[2]: r[5] for r in once if r[0] == 1} == first and len(once) == 13
    for n in (1, 7, 10**6):
        monkeypatch.setattr(d, "SEGMENT_WORDS", n)
        assert sorted(map(tuple, d.find_passages(docs, table).collect())) == once
