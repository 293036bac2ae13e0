"""Ids and texts against the library that the vocabulary belongs to."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sheafline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
CHARACTERS = [chr(c) for c in [*range(300), 0x1680, 0x2000, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x2581, 0x200B, 0xFEFF, 0xFDD0]] + [
    "<|endoftext|>", "  ", "'s", "\r\n", "the", "ing"]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sample():
    rnd = random.Random(3)
    return ["", " ", "\n\n  x ", "a" * 5000, "ab" * 3000, "aaab" * 999, " " * 300, "<|endoftext|><|endoftext|> x", "the end <|endoftext|"] + [
        "".join(rnd.choice(CHARACTERS) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]


def check(spark, library, texts):
    rows = [(i, t, [1], "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string, `a.b` string").repartition(3)
    got = {r["doc_id"]: r for r in bpe.decode_texts(bpe.encode_texts(docs, PATH), PATH).collect()}
    assert len(got) == len(texts)
    for i, (text, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert got[i]["ids"] == e.ids, repr(text)
        assert got[i]["decoded"] == library.decode(e.ids, skip_special_tokens=False) == text


def test_ids_and_texts_match_the_library(spark, library):
    check(spark, library, sample())


def test_small_blocks_and_a_small_memory_change_nothing(library, merges, monkeypatch):
    for name, value in (("INDEXED", 50), ("REMEMBERED", 500), ("WORDS", 7), ("CHARACTERS", 40)):
        monkeypatch.setattr(bpe, name, value)
    texts = sample()[:400]
    ids, counts = bpe.Encoder(merges).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_blocks_of_rows_hold_every_row_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CHARACTERS", 10)
    batch = pa.array(["abc", "", "x" * 50, "", "ab", None, "abcdefgh", "i", "jk"])
    parts = list(bpe._blocks(batch))
    assert [t for p in parts for t in p.to_pylist()] == batch.to_pylist() and len(parts) > 3


def test_a_very_long_text_and_a_very_long_word(library, merges):
    rnd = random.Random(4)
    long_text = " ".join(rnd.choice(["the", "running", "Ünïcode", "x1", "naïve", "..."]) for _ in range(300_000))
    long_word = "".join(rnd.choice("abcdeinorst") for _ in range(400_000))
    ids, counts = bpe.Encoder(merges).encode([long_text, long_word])
    want = [e.ids for e in library.encode_batch([long_text, long_word], add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == want[0] + want[1]


def test_nulls_repeats_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b")], "doc_id long, text string")
    got = bpe.decode_texts(bpe.encode_texts(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"], len(r["ids"])) for r in got) == [(0, "a b", 2), (1, "", 0), (1, "", 0), (2, "a b", 2), (2, "a b", 2)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode_texts(bpe.encode_texts(empty, PATH), PATH).count() == 0


def test_decoding_parts_of_characters_nulls_and_unknown_ids(spark, library):
    euro = library.encode("€", add_special_tokens=False).ids
    cases = [euro, euro[:1], euro[1:], [], None, euro[:1] + euro, [50256, 50256]]
    held = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "doc_id long, ids array<int>").coalesce(1)
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_texts(held, PATH).collect()}
    for i, c in enumerate(cases):
        assert got[i] == (None if c is None else library.decode(c, skip_special_tokens=False))
    odd = spark.createDataFrame([(1, [-1, 10**6, None, 64])], "doc_id long, ids array<int>")
    assert bpe.decode_texts(odd, PATH).first()["decoded"] == library.decode([64])


def test_merges_out_of_order_are_refused(tmp_path):
    held = json.load(open(PATH, encoding="utf-8"))
    held["model"]["merges"] = held["model"]["merges"][::-1]
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(held), encoding="utf-8")
    with pytest.raises(ValueError, match="before its parts"):
        bpe.Merges(str(path))
