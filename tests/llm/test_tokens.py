"""Token counts against the library that the vocabulary belongs to."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from sheafline.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
CHARACTERS = [chr(c) for c in [*range(300), 0x1680, 0x2000, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x2581, 0x200B, 0xFEFF, 0xFDD0]] + [
    "<|endoftext|>", "  ", "'s", "\r\n", "the", "ing"]


def sample():
    rnd = random.Random(2)
    return ["", " ", "\n\n  x ", "a" * 5000, "ab" * 3000, " " * 300, "<|endoftext|><|endoftext|> x", "the end <|endoftext|"] + [
        "".join(rnd.choice(CHARACTERS) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]


def test_counts_match_the_library(spark):
    texts = sample()
    library = Tokenizer.from_file(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = [*((i, t, 0) for i, t in enumerate(texts)), (None, "a", 0), (9, None, 0), (9, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = tokens.count_tokens(docs, PATH, limit=20).collect()
    assert len(got) == len(rows)
    held = {r["doc_id"]: r for r in got if r["doc_id"] not in (9, None)}
    for i, (text, n) in enumerate(zip(texts, want)):
        if i != 9:
            assert (held[i]["n_tokens"], held[i]["n_bytes"], held[i]["over_limit"]) == (n, len(text.encode()), n > 20)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] == 9 and not r["n_bytes"]) == [(0, 0), (0, 0)]


def test_a_small_memory_changes_nothing(monkeypatch):
    counter = tokens.TokenCounter(PATH)
    texts = sample()[:200]
    want = [counter.count(t) for t in texts]
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "LISTED", 10)
    assert [tokens.TokenCounter(PATH).count(t) for t in texts[:3]] == want[:3]
    counter.counts.clear()
    assert [counter.count(t) for t in texts] == want


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
