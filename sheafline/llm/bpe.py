"""Byte-pair encoding by an index of pair occurrences, and decoding.

The words of a partition that have not been met before are laid out as one row of symbols. An index maps every pair that a
merge knows to all its places in that row; the active ranks are taken in ascending order, each merge is made at all its places
at once, and the pairs that this breaks or makes change the index. As a merge only ever makes pairs of later merges, the
order over the whole row is the order within each word. Each distinct word is encoded once; texts are then gathered from the
words' ids. Rows are independent, so Spark splits the work by input partition and nothing is shuffled.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import give_back, texts
from sheafline.llm.tokens import PRE_TOKENS, byte_symbols

# Bytes of distinct words that share one index of occurrences.
INDEXED = 1 << 20
# Bytes of distinct words remembered by one task.
REMEMBERED = 16 << 20
# Words of a text taken up at once, and characters of the texts handed on together.
WORDS, CHARACTERS = 200_000, 2_000_000


class Merges:
    """A byte-level vocabulary: the id of each byte, and for each pair of ids the rank and the id of its merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        before, model = held["pre_tokenizer"] or {}, held["model"]
        if held["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        special = held["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("added tokens that take in neighbouring characters are not supported")
        ids, written = model["vocab"], byte_symbols()
        self.byte_ids = np.array([ids[c] for c in written], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left, self.right = [ids[a] for a, _ in pairs], [ids[b] for _, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        born = {int(i): -1 for i in self.byte_ids}
        for rank, (a, b, c) in enumerate(zip(self.left, self.right, self.made)):
            if born.get(a, rank) >= rank or born.get(b, rank) >= rank or c in born:
                raise ValueError(f"{path}: merge {rank} comes before its parts, or makes a token that is there already")
            born[c] = rank
        self.size = max(ids.values(), default=0) + 1
        self.ranks = {a * self.size + b: rank for rank, (a, b) in enumerate(zip(self.left, self.right))}
        # The rank of each pair of bytes, -1 where no merge takes it.
        self.byte_ranks = np.full(65536, -1, dtype=np.int32)
        for i, a in enumerate(self.byte_ids.tolist()):
            for j, b in enumerate(self.byte_ids.tolist()):
                self.byte_ranks[i << 8 | j] = self.ranks.get(a * self.size + b, -1)
        byte_of = {c: b for b, c in enumerate(written)}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in special}
        self.special = {t["content"]: t["id"] for t in special}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if special else None
        self.words = regex.compile(PRE_TOKENS)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words and special strings of a text, in lists of bounded length."""
        pieces = self.cut.split(text) if self.cut else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                yield [piece]
            elif len(piece) <= WORDS:
                yield self.words.findall(piece)
            else:
                found = (m[0] for m in self.words.finditer(piece))
                while block := list(islice(found, WORDS)):
                    yield block


def merge_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and how many each word has."""
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    n = len(flat)
    if not n:
        return np.zeros(0, dtype=np.int32), lengths
    last = np.zeros(n, dtype=bool)
    last[ends[lengths > 0] - 1] = True
    first = np.zeros(n, dtype=bool)
    first[(ends - lengths)[lengths > 0]] = True
    places = np.arange(n, dtype=np.int32)
    symbols = array("i", merges.byte_ids[flat].tobytes())
    after = array("i", np.where(last, -1, places + 1).astype(np.int32).tobytes())
    before = array("i", np.where(first, -1, places - 1).astype(np.int32).tobytes())

    # The index: each rank with all places of its pair.
    ranks = np.full(n, -1, dtype=np.int32)
    ranks[:-1] = merges.byte_ranks[flat[:-1].astype(np.int32) << 8 | flat[1:]]
    ranks[last] = -1
    held = np.flatnonzero(ranks >= 0)
    held = held[np.argsort(ranks[held], kind="stable")]
    cuts = np.flatnonzero(np.diff(ranks[held], prepend=-1))
    index: dict[int, list[int]] = {int(ranks[part[0]]): part.tolist() for part in np.split(held, cuts)[1:]} if len(held) else {}

    active = list(index)
    heapify(active)
    rank_of, size = merges.ranks.get, merges.size
    while active:
        rank = heappop(active)
        left, right, made = merges.left[rank], merges.right[rank], merges.made[rank]
        for p in sorted(index.pop(rank)):
            if symbols[p] != left or (q := after[p]) < 0 or symbols[q] != right:
                continue  # one of the two has gone into another merge
            symbols[p], symbols[q] = made, -1
            k = after[p] = after[q]
            if k >= 0:
                before[k] = p
                if (r := rank_of(made * size + symbols[k])) is not None:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heappush(active, r)
            h = before[p]
            if h >= 0 and (r := rank_of(symbols[h] * size + made)) is not None:
                if r in index:
                    index[r].append(h)
                else:
                    index[r] = [h]
                    heappush(active, r)
    ids = np.frombuffer(symbols, dtype=np.int32)
    alive = np.concatenate([[0], np.cumsum(ids >= 0)])
    return ids[ids >= 0], alive[ends] - alive[ends - lengths]


class Encoder:
    """Ids of texts; distinct words are remembered up to ``REMEMBERED`` bytes."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = 0

    def _learn(self, words: list[str]) -> None:
        """Encode words that have no code yet, as many at a time as one index holds."""
        at = 0
        while at < len(words):
            block, size = [], 0
            while at < len(words) and (not block or size + len(words[at]) <= INDEXED):
                special = words[at] in self.merges.special
                block.append(b"" if special else words[at].encode("utf-8", "surrogatepass"))
                size += len(block[-1])
                at += 1
            ids, lengths = merge_words(block, self.merges)
            for i, word in enumerate(words[at - len(block):at]):
                if word in self.merges.special:
                    ids = np.insert(ids, lengths[:i].sum(), self.merges.special[word])
                    lengths[i] = 1
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.codes.update(zip(words[at - len(block):at], range(len(self.lengths), len(self.lengths) + len(block))))
            self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.bytes += size

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and where each word's begin (one more entry: the end)."""
        if self.bytes > REMEMBERED:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.codes]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, words), dtype=np.int64, count=len(words))
        lengths = self.lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(self.starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def encode(self, batch: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and the number each text has."""
        found, counts, words, ends = [], [], [], []

        def flush() -> None:
            ids, at = self.encode_words(words)
            found.append(ids)
            for row, upto in ends:  # the words up to ``upto`` that no earlier entry took belong to ``row``
                counts[row] += at[upto]
            for (row, _), (_, upto) in zip(ends[1:], ends):
                counts[row] -= at[upto]
            words.clear()
            ends.clear()

        for row, text in enumerate(batch):
            counts.append(0)
            for part in self.merges.parts(text):
                words.extend(part)
                ends.append((row, len(words)))
                if len(words) >= WORDS:
                    flush()
        flush()
        return np.concatenate(found), np.array(counts, dtype=np.int64)


def _blocks(batch: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of texts of about ``CHARACTERS`` bytes or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHARACTERS, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def token_ids(text: Column, vocabulary: str) -> Column:
    """``array<int>``: the ids of a text (a null text counts as empty)."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Merges(vocabulary))
        for batch in batches:
            for part in _blocks(batch):
                ids, counts = encoder.encode(part.to_pylist())
                yield pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids, pa.int32()))
        del encoder
        give_back()

    return encode(F.coalesce(text.cast("string"), F.lit("")))


class Decoder:
    """Texts of rows of ids. Bytes that are no UTF-8 become replacement characters; an id without a token gives nothing."""

    def __init__(self, merges: Merges):
        size = max(merges.bytes_of, default=-1) + 1
        self.tokens = pa.array([merges.bytes_of.get(i, b"") for i in range(size)] + [b""], pa.binary())
        self.size = size

    def decode(self, rows: pa.ListArray) -> pa.Array:
        values, ends = rows.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))])
        ids = pc.fill_null(values, self.size).to_numpy(zero_copy_only=False)
        ids = np.where((ids < 0) | (ids > self.size), self.size, ids)
        parts = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.tokens.take(pa.array(ids)).cast(pa.large_binary()))
        joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
        try:
            decoded = joined.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            decoded = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
        return pc.if_else(rows.is_valid(), decoded, pa.scalar(None, pa.string()))


def decoded_text(ids: Column, vocabulary: str) -> Column:
    """The text of a row of ids (null for null)."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(Merges(vocabulary))
        for batch in batches:
            yield decoder.decode(batch)
        give_back()

    return decode(ids)


def encode_texts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text: ``doc_id, ids``.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has; its special strings are one token each inside
    a text too. A null or empty text has no ids; a null id stays null; repeated rows are encoded each; an empty table gives no
    rows; other columns are not looked at, whatever their names. Very long texts and words are encoded whole, a text's
    words in blocks.
    """
    return texts(docs, id_column, text_column).select("doc_id", token_ids(F.col("text"), vocabulary).alias("ids"))


def decode_texts(encoded: DataFrame, vocabulary: str, ids_column: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded`` of a table of ``doc_id`` and ids: the text of each row, null for null, empty for no ids."""
    held = encoded.select("doc_id", F.col(ids_column).cast("array<int>").alias("ids"))
    return held.withColumn("decoded", decoded_text(F.col("ids"), vocabulary))
