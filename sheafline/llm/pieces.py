"""Encoding into sentence pieces with seeded merge dropout, and decoding.

The vocabulary is a merge-type (BPE) sentence-piece model. Text becomes characters with spaces written as ``▁``; an
agenda holds the adjacent pairs whose union is a piece, best score first. A pair that comes up is skipped when a
keyed hash of seed, document, segment, piece and place falls under the dropout rate, so equal seeds give equal pieces, and other
seeds or documents give others. Characters without a piece become byte pieces, and so does a ``▁`` of the text itself:
decoding gives back the very text whatever was dropped. No merge crosses from a letter to a ``▁``, so segments between
spaces are independent: the agendas of all segments of a block of texts are worked through together, one row of an array each.
Nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sheafline.llm.common import give_back, texts

SPACE = "▁"
# Characters of distinct segments remembered by one task.
REMEMBERED = 16_000_000
# Bytes of text encoded together.
BLOCK = 2_000_000
# Segments whose agendas are rows of one array, and the widths of such arrays; longer segments have a heap each.
ROWS, WIDTHS = 32_768, (4, 8, 12, 16, 24, 32, 64)
NEVER = np.iinfo(np.int32).max
# Bits of the dropout hash: small enough that Python keeps it in one machine word.
BITS = 30


class PieceModel:
    """A merge-type sentence-piece vocabulary with its agenda encoder and its decoder."""

    def __init__(self, path: str, seed: int = 0, dropout: float = 0.0):
        held = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(held.get_piece_size())
        self.pieces = [held.id_to_piece(i) for i in ids]
        if not any(held.is_byte(i) for i in ids):
            raise ValueError(f"{path} has no byte pieces, so it cannot write every text")
        plain = [i for i in ids if not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i) or held.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        best_first = sorted(plain, key=lambda i: (-held.get_score(i), i))
        self.ranks = {self.pieces[i]: r for r, i in enumerate(best_first)}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if held.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.written = [None if i in self.byte_of else self.pieces[i].replace(SPACE, " ") for i in ids]
        if SPACE not in self.ids:
            raise ValueError(f"{path} has no piece for a space")
        self.crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.segments = re.compile("(?s:.+)" if self.crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.seed, self.below = seed, int(dropout * 2**BITS)
        short_hash = lambda kind, i: xxh64_intdigest(f"{kind}{i}".encode(), seed) >> 64 - BITS
        self.of_piece = [short_hash("piece", r) for r in range(len(plain))]
        self.of_place = [short_hash("place", i) for i in range(1024)]
        self.of_piece, self.of_place = np.array(self.of_piece, dtype=np.int64), np.array(self.of_place, dtype=np.int64)
        # Pieces by rank: their ids, and which pairs of them make a piece.
        self.by_rank = np.array(best_first, dtype=np.int32)
        pairs = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        # What stands for each character: the rank of its piece, or less than -1 without one.
        self.symbol_of = -2 - np.arange(0x110000, dtype=np.int32)
        for piece, rank in self.ranks.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.unions = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair of pieces makes, ``NEVER`` where it makes none (always below 0)."""
        if not len(self.pair_keys):
            return np.full(len(left), NEVER, dtype=np.int32)
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.unions[at], NEVER)

    def key(self, hashes: np.ndarray, variants: np.ndarray) -> np.ndarray:
        """The key of the dropout hash of segments in documents, from a hash of each."""
        mixed = hashes ^ variants.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - BITS)).astype(np.int64)

    def agendas(self, symbols: np.ndarray, keys: np.ndarray) -> None:
        """Work through the agendas of segments of one width: ``symbols`` holds what stands for each character, -1 beyond the end, and
        gets the rank of the piece that begins at each place, -1 inside pieces.

        A row's agenda is the union of each place with the next; its least entry, the leftmost of equals, is taken next.
        """
        n, width = symbols.shape
        agenda = np.full((n, width), NEVER, dtype=np.int32)
        agenda[:, :-1] = self.union(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        rows = np.arange(n)
        while len(rows):
            at = agenda[rows].argmin(axis=1)
            best = agenda[rows, at]
            open_ = best != NEVER
            rows, at, best = rows[open_], at[open_], best[open_]
            if self.below:
                dropped = (keys[rows] ^ self.of_piece[best] ^ self.of_place[at & 1023]) < self.below
                agenda[rows[dropped], at[dropped]] = NEVER  # this union is not made here, a later one may take the pair in
                r, i, piece = rows[~dropped], at[~dropped], best[~dropped]
            else:
                r, i, piece = rows, at, best
            j = after[r, i]
            symbols[r, i], symbols[r, j], agenda[r, j] = piece, -1, NEVER
            k = after[r, i] = after[r, j]
            inner = k < width
            beside = np.where(inner, symbols[r, np.minimum(k, width - 1)], -1)
            agenda[r, i] = self.union(piece, beside)
            before[r[inner], k[inner]] = i[inner]
            h = before[r, i]
            led = h >= 0
            r, h, piece = r[led], h[led], piece[led]
            agenda[r, h] = self.union(symbols[r, h], piece)

    def segment_ids(self, segment: str, variant: int) -> tuple[int, ...]:
        """Pieces of one segment, by a heap."""
        hashed = np.array([xxh64_intdigest(segment, self.seed)], dtype=np.uint64)
        return self._ids_of(segment, int(self.key(hashed, np.array([variant], dtype=np.int64))[0]))

    def _ids_of(self, segment: str, key: int) -> tuple[int, ...]:
        merged = self._long(segment, key)
        try:
            return tuple(map(self.ids.__getitem__, merged))
        except KeyError:  # characters without a piece
            parts = [(self.ids[m],) if m in self.ids else [self.bytes[b] for b in m.encode("utf-8", "surrogatepass")] for m in merged]
            return tuple(itertools.chain.from_iterable(parts))

    def _long(self, segment: str, key: int) -> list[str]:
        """The agenda as a heap over linked symbols, for segments of any length."""
        symbols, rank, below, of_piece, of_place = list(segment), self.ranks, self.below, self.of_piece, self.of_place
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, p) for i, p in enumerate(map(add, symbols, symbols[1:])) if (r := rank.get(p)) is not None]
        heapify(agenda)
        while agenda:
            best, i, piece = heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != piece:
                continue
            if below and key ^ of_piece[best] ^ of_place[i & 1023] < below:
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (r := rank.get(p := piece + symbols[k])) is not None:
                    heappush(agenda, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := symbols[h] + piece)) is not None:
                heappush(agenda, (r, h, p))
        return [s for s in symbols if s]

    def segments_of(self, text: str) -> list[str]:
        """The segments of a text; an empty one stands for a ``▁`` of the text itself."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and not self.crossing:
            # With single spaces only, each word and the space before it are a segment.
            return [SPACE + word for word in text.split(" ")]
        out: list[str] = []
        for i, part in enumerate((" " + text).split(SPACE)):
            if i:
                out.append("")
            out += self.segments.findall(part.replace(" ", SPACE))
        return out

    def encode(self, text: str, variant: int = 0) -> list[int]:
        """Ids of a text; the empty text has none."""
        return Encoder(self).encode([text], [variant])[0].tolist()

    def decode(self, ids) -> str:
        """The text of a row of ids."""
        parts = list(map(self.written.__getitem__, ids))
        if None in parts:
            for first, group in itertools.groupby(range(len(ids)), lambda at: parts[at] is None):
                if first:
                    at = list(group)
                    raw = bytes(self.byte_of[ids[k]] for k in at).decode("utf-8", "surrogatepass")
                    parts[at[0]:at[-1] + 1] = [raw] + [""] * (len(at) - 1)
        return "".join(parts)[1:]


class Encoder:
    """Ids of blocks of texts. Distinct segments are looked up once and remembered up to ``REMEMBERED`` characters."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.literal = np.array([model.bytes[b] for b in SPACE.encode()], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.names: list[str] = []
        self.hashes, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.symbols, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, segments: list[str]) -> None:
        """Hash, characters and length of new segments; length 0 marks those that are no row of an array."""
        self.codes.update(zip(segments, range(len(self.names), len(self.names) + len(segments))))
        self.names += segments
        short = [s if len(s) <= WIDTHS[-1] else "" for s in segments]
        sizes = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
        points = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.starts = np.concatenate([self.starts, len(self.symbols) + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.symbols = np.concatenate([self.symbols, self.model.symbol_of[points]])
        hashes = np.fromiter((xxh64_intdigest(s, self.model.seed) for s in segments), dtype=np.uint64, count=len(segments))
        self.hashes = np.concatenate([self.hashes, hashes])

    def _merged(self, codes: np.ndarray, variants: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments in documents, where each begins among them, and how many it has."""
        model, n = self.model, len(codes)
        keys = model.key(self.hashes[codes], variants)
        lengths, counts, starts = self.lengths[codes], np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        found, total, narrow = [], 0, 0
        for width in WIDTHS:
            fitting = np.flatnonzero((lengths > narrow) & (lengths <= width))
            narrow = width
            for at in range(0, len(fitting), ROWS):
                part = fitting[at:at + ROWS]
                inside = np.arange(width) < lengths[part][:, None]
                rows = np.full((len(part), width), -1, dtype=np.int32)
                rows[inside] = self.symbols[(self.starts[codes[part]][:, None] + np.arange(width))[inside]]
                model.agendas(rows, keys[part])
                left = rows != -1
                held, counts[part] = rows[left], left.sum(axis=1)
                unknown = np.flatnonzero(held < 0)
                ids = model.by_rank[np.maximum(held, 0)]
                if len(unknown):
                    written = [chr(-2 - c).encode("utf-8", "surrogatepass") for c in held[unknown].tolist()]
                    more = np.array([len(b) - 1 for b in written])
                    np.add.at(counts, part[np.nonzero(left)[0][unknown]], more)
                    taken = np.ones(len(held), dtype=np.int64)
                    taken[unknown] += more
                    ids = np.repeat(ids, taken)
                    ends = np.cumsum(taken)[unknown]
                    for end, raw in zip(ends.tolist(), written):
                        ids[end - len(raw):end] = [model.bytes[b] for b in raw]
                starts[part] = total + np.cumsum(counts[part]) - counts[part]
                found.append(ids)
                total += len(ids)
        for i in np.flatnonzero(lengths == 0).tolist():
            name = self.names[codes[i]]
            ids = np.array(model._ids_of(name, int(keys[i])), dtype=np.int32) if name else self.literal
            starts[i], counts[i] = total, len(ids)
            found.append(ids)
            total += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *found]), starts, counts

    def encode(self, block: Sequence[str], variants: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        if len(self.symbols) + len(self.names) > REMEMBERED:
            self.forget()
        segments, numbers = [], []
        for text in block:
            own = self.model.segments_of(text)
            segments += own
            numbers.append(len(own))
        new = [s for s in dict.fromkeys(segments) if s not in self.codes]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, segments), dtype=np.int64, count=len(segments))
        # Equal segments of equal variants are merged once.
        kinds, kind_of = np.unique(np.array(variants, dtype=np.int64), return_inverse=True)
        pairs, pair_of = np.unique(np.repeat(kind_of, numbers) * len(self.names) + codes, return_inverse=True)
        ids, starts, counts = self._merged(pairs % max(1, len(self.names)), kinds[pairs // max(1, len(self.names))])
        lengths = counts[pair_of]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        laid = ids[np.repeat(starts[pair_of] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(numbers)])]
        return laid, np.diff(bounds)


@lru_cache(maxsize=2)
def held_model(path: str, seed: int = 0, dropout: float = 0.0) -> PieceModel:
    """A model that stays with the Python worker from task to task: vocabulary and pairs, nothing that grows."""
    return PieceModel(path, seed, dropout)


def variant_of(id_column: Column, seed: int, variants: int) -> Column:
    """Which segmentation a row gets: a keyed hash of its id, one of ``variants`` (0: of all)."""
    hashed = F.xxhash64(F.lit(seed), id_column)
    return F.pmod(hashed, F.lit(variants)).cast("long") if variants else hashed


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in size, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto
        at = upto


def piece_ids(text: Column, variant: Column, model: str, seed: int, dropout: float) -> Column:
    """``struct<ids, lossless>`` of a text: its pieces, and whether they were decoded back to the same text."""

    @F.arrow_udf("ids array<int>, lossless boolean")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held = held_model(model, seed, dropout)
        encoder = Encoder(held)
        raw = [b"" if w is None else w.encode("utf-8", "surrogatepass") for w in held.written]
        for i, b in held.byte_of.items():
            raw[i] = bytes([b])
        raw = pa.array(raw, pa.binary())
        for batch, chosen in batches:
            for at, upto in blocks(pc.binary_length(batch).to_numpy(zero_copy_only=False), BLOCK):
                part = batch.slice(at, upto - at)
                ids, counts = encoder.encode(part.to_pylist(), chosen.slice(at, upto - at).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)])
                # The bytes of a row's pieces are a space and the text.
                parts = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), raw.take(pa.array(ids)).cast(pa.large_binary()))
                joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
                given = part.cast(pa.binary()).cast(pa.large_binary())
                led = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), given, pa.scalar(b"", pa.large_binary()))
                lossless = pc.equal(joined, pc.if_else(pc.equal(pc.binary_length(given), 0), given, led))
                yield pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), lossless], ["ids", "lossless"])
        del encoder
        give_back()

    return encode(F.coalesce(text.cast("string"), F.lit("")), variant)


def encode_pieces(docs: DataFrame, model: str, seed: int = 17, dropout: float = 0.1, variants: int = 0,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of every whole text: ``doc_id, variant, n_pieces, ids, lossless``.

    ``model`` is the path of a merge-type model that every executor has. ``variant`` is a keyed hash of the id: each document has its
    own segmentation, in which equal words are cut alike, or one of ``variants`` if that is not 0. ``lossless`` says that decoding ``ids`` gave
    back the text; it is checked on every row. A null or empty text has no pieces; a null id stays null; repeated rows
    are encoded each; an empty table gives no rows; other columns are not looked at.
    """
    rows = texts(docs, id_column, text_column).withColumn("variant", variant_of(F.col("doc_id"), seed, variants))
    made = rows.withColumn("_made", piece_ids(F.col("text"), F.col("variant"), model, seed, dropout))
    return made.select("doc_id", "variant", F.size("_made.ids").cast("long").alias("n_pieces"), "_made.ids", "_made.lossless")


def decode_pieces(encoded: DataFrame, model: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of each row of ids (null for null)."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = held_model(model)
        for batch in batches:
            yield pd.Series([None if ids is None else held.decode([int(i) for i in ids]) for ids in batch], dtype=object)

    return encoded.withColumn("decoded", decode(F.col(ids_column)))
