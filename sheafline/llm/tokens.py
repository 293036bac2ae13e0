"""Token counts by byte-pair merging with a heap of ranks over a linked list of symbols.

Only counts are made: a pre-token of ``n`` bytes has ``n`` symbols, every merge takes one away, and no token
identifier is looked up. Rows are independent, so Spark splits the work by input partition and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import texts

# Fixed value: how byte-level vocabularies of this kind cut text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Distinct pre-tokens remembered by one task.
REMEMBERED = 400_000
# Above this many characters pre-tokens are walked one by one instead of listed.
LISTED = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable in
    Latin-1, else the next free character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the lowest-ranked adjacent pair is merged again and again."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(p)) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue  # one of the two has been merged with another neighbour meanwhile
        symbols[i], symbols[j] = pair[0] + pair[1], ""
        merges += 1
        k = after[i] = after[j]
        after[j] = n
        if k < n:
            before[k] = i
            if (r := ranks.get(p := (symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, p))
        if (h := before[i]) >= 0 and (r := ranks.get(p := (symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, p))
    return n - merges


class _Counts(dict):
    """Pre-token to number of tokens, filled when first asked."""

    def __init__(self, ranks):
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        self[word] = n = merged_count(symbols, self.ranks) if len(symbols) > 1 else len(symbols)
        return n


class TokenCounter:
    """Counts tokens as the vocabulary file says; special strings inside a text are one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        before, model = held["pre_tokenizer"] or {}, held["model"]
        if held["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        special = held["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("added tokens that take in neighbouring characters are not supported")
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.counts = _Counts({pair: rank for rank, pair in enumerate(merges)})
        self.words = regex.compile(PRE_TOKENS)
        longest_first = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if special else None

    def count(self, text: str) -> int:
        if not self.special:
            return self._ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))

    def _ordinary(self, text: str) -> int:
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        if len(text) <= LISTED:
            return sum(map(self.counts.__getitem__, self.words.findall(text)))
        total = 0
        for match in self.words.finditer(text):
            total += self.counts[match[0]]
            if len(self.counts) > REMEMBERED:
                self.counts.clear()
        return total


def token_count(text: Column, vocabulary: str) -> Column:
    """Number of tokens of ``text`` (null counts as empty)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    return count(F.coalesce(text.cast("string"), F.lit("")))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Bytes and tokens of every row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has. A null or empty text has 0 bytes and
    0 tokens; a null id stays null; repeated rows are counted each; an empty table gives no rows; other columns are
    not looked at, whatever their names. Very long texts and words are counted whole.
    """
    counted = texts(docs, id_column, text_column).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
