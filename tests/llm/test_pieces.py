"""Pieces against the library without dropout, and exact round trips with it."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from sheafline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
CHARACTERS = [chr(c) for c in [*range(300), 0x1680, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x200B, 0xFEFF, 0xFDD0]] + ["  ", " the", "ing ", "\n", "   "]


def sample(extra=()):
    rnd = random.Random(4)
    return ["", " ", "  ", "a", " a", "a ", "a  b", "x" * 3000, "<s></s><0x41>", "the end", "ab " * 2000] + [
        "".join(rnd.choice(CHARACTERS + list(extra)) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]


def test_without_dropout_as_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    held = pieces.PieceModel(PATH)
    for text in sample():
        assert held.encode(text) == library.encode(text, num_threads=1), text[:80]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_rows_of_an_array_and_heaps_agree(monkeypatch, dropout):
    held = pieces.PieceModel(PATH, 5, dropout)
    texts = sample(["▁"]) + ["x" * n + " the" for n in range(1, 80)]
    variants = [i % 7 - 3 for i in range(len(texts))]
    ids, counts = pieces.Encoder(held).encode(texts, variants)
    want = []
    for text, variant in zip(texts, variants):
        literal = tuple(held.bytes[b] for b in pieces.SPACE.encode())
        want.append([i for s in held.segments_of(text) for i in (held.segment_ids(s, variant) if s else literal)])
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    monkeypatch.setattr(pieces, "ROWS", 5)
    monkeypatch.setattr(pieces, "WIDTHS", (3, 20))
    assert pieces.Encoder(held).encode(texts, variants)[0].tolist() == ids.tolist()


def plain_dropout(held, segment, variant):
    """The agenda in plain words: the best union of neighbours that has not been dropped where it stands."""
    key = int(held.key(np.array([xxhash.xxh64_intdigest(segment, held.seed)], dtype=np.uint64), np.array([variant]))[0])
    parts, refused = [(i, c) for i, c in enumerate(segment)], set()
    while True:
        open_ = [(held.ranks[a + b], i, a + b) for (i, a), (_, b) in zip(parts, parts[1:]) if a + b in held.ranks and (i, a, b) not in refused]
        if not open_:
            return [p for _, p in parts]
        rank, place, piece = min(open_)
        at = next(n for n, (i, _) in enumerate(parts) if i == place)
        if key ^ int(held.of_piece[rank]) ^ int(held.of_place[place & 1023]) < held.below:
            refused.add((place, parts[at][1], parts[at + 1][1]))
        else:
            parts[at:at + 2] = [(place, piece)]


def test_dropout_matches_a_plain_agenda():
    held = pieces.PieceModel(PATH, 8, 0.3)
    words = ["▁different", "▁configurations", "▁the", "▁▁▁customer", "▁tomorrow.", "aaaaaaaa", "▁" + "orders" * 14]
    for word in words:
        for variant in range(-5, 25):
            assert [held.pieces[i] for i in held.segment_ids(word, variant)] == plain_dropout(held, word, variant)


def test_dropout_varies_and_decodes_exactly():
    texts = sample(["▁", "▁▁"])
    one, two = pieces.PieceModel(PATH, 1, 0.3), pieces.PieceModel(PATH, 2, 0.3)
    plain = pieces.PieceModel(PATH)
    for text in texts:
        ids = one.encode(text)
        assert ids == one.encode(text) and one.decode(ids) == text == one.decode(one.encode(text, 1))
    line = "The quick brown customer orders several different configurations tomorrow."
    assert len({tuple(m.encode(line, v)) for m in (one, two) for v in (0, 1)} | {tuple(plain.encode(line))}) == 5
    everything = pieces.PieceModel(PATH, 1, 1.0)
    assert len(everything.encode(line)) == len(line) + 1
    # The rate is that of the parameter: with one candidate, about a third of the segments stay apart.
    apart = sum(len(one.segment_ids(f"{a}{b}", 0)) == 2 for a in "theaoins" for b in "theaoins" if f"{a}{b}" in one.ids)
    whole = sum(f"{a}{b}" in one.ids for a in "theaoins" for b in "theaoins")
    assert 0.1 < apart / whole < 0.55


def test_operator_and_decoder(spark):
    rows = [*enumerate(sample(["▁"])[:300]), (None, "x y"), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    out = pieces.encode_pieces(docs, PATH, dropout=0.2)
    assert out.columns == ["doc_id", "variant", "n_pieces", "ids", "lossless"]
    got = pieces.decode_pieces(out, PATH).collect()
    assert len(got) == len(rows) and all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in got)
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t in rows)
    assert len({r["variant"] for r in got}) == len({i for i, _ in rows})
    two = pieces.encode_pieces(docs, PATH, variants=2)
    assert {r["variant"] for r in two.collect()} == {0, 1}
    again = {r["doc_id"]: r["ids"] for r in out.where("doc_id > 5").collect()}
    assert again == {r["doc_id"]: r["ids"] for r in got if r["doc_id"] is not None and r["doc_id"] > 5}
    assert out.where(F.lit(False)).count() == 0
    assert pieces.encode_pieces(docs.limit(0), PATH).count() == 0


def test_a_small_memory_and_small_blocks_change_nothing(spark, monkeypatch):
    texts = sample()[:200]
    held = pieces.PieceModel(PATH, 3, 0.2)
    want = [held.encode(t, i) for i, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "REMEMBERED", 2)
    encoder = pieces.Encoder(held)
    assert [encoder.encode([t], [i])[0].tolist() for i, t in enumerate(texts)] == want
    assert list(pieces.blocks(np.array([3, 0, 9, 1, 1, 0]), 4)) == [(0, 2), (2, 3), (3, 6)] and not list(pieces.blocks(np.zeros(0), 4))


def test_a_very_long_text_and_word():
    held = pieces.PieceModel(PATH, 3, 0.1)
    for text in ("word " * 200_000, "abcdeinorst" * 20_000):
        assert held.decode(held.encode(text)) == text
