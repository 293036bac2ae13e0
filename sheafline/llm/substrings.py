"""Removal of long word sequences that an earlier document has too, by recompression.

1. Every text is recompressed where it lies (``recompression``). The names of symbols of ``LEAST`` words or more go through one
   aggregation that finds those of more than one document.
2. A symbol of a single document rules out every window that holds the words which decided it: were the window elsewhere, the
   symbol would be too. Windows that no symbol rules out are left; texts without any are done.
3. The windows left are compared by a 96-bit hash of their words: an aggregation finds the least document of each, a join
   marks the windows of larger ones, and the words they cover go.

Names are content hashes, so rounds need no dictionary and no shuffle of their own. Aggregations combine before they shuffle, so a
window or symbol that a third of all documents share is one record per task; the joins back put one row beside each occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import stored
from sheafline.llm.recompression import mix, recompress

WINDOW, LEAST = 50, 4
# Words that are worked on at once (a longer text by itself).
TOGETHER = 400_000
NO_ID = 2**63 - 1
SPACES = r"[\x20\x09-\x0D]+"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the hashes of their words laid end to end, and where each text begins (and the last ends)."""
    lengths = pc.list_value_length(batch["hashes"]).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths) // TOGETHER
    for first in np.unique(group, return_index=True)[1]:
        n = int((group == group[first]).sum())
        part = batch.slice(int(first), n)
        words = part["hashes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        yield part, words, np.concatenate([[0], np.cumsum(lengths[first:first + n])])


def _symbols(words: np.ndarray, begins: np.ndarray, least: int):
    """Symbols of at least ``least`` words whose deciding words lie in one window of their text; and their text's number."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    s = recompress(words, text)
    of = text[s.start]
    good = (s.end - s.start >= least) & (s.low >= begins[of]) & (s.high <= begins[of + 1])
    return s.keep(good), of[good]


def _window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> list[np.ndarray]:
    """Two polynomial hashes of the ``window`` words from each start; the second is cut to 32 bits."""
    out = []
    for base in _BASES:
        turned = mix(words ^ np.uint64(base))
        powers = np.full(window, base, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        value = np.zeros(len(starts), dtype=np.uint64)
        for k in range(window):
            value += turned[starts + k] * powers[k]
        out.append(mix(value))
    return [out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)]


def _symbol_rows(window: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, begins in _parts(batch):
                s, of = _symbols(words, begins, least)
                close = s.high - s.low <= window
                name, of = s.name[close].view(np.int64), of[close]
                order = np.lexsort((name, of))
                fresh = np.ones(len(order), dtype=bool)
                fresh[1:] = (name[order][1:] != name[order][:-1]) | (of[order][1:] != of[order][:-1])
                name, of = name[order][fresh], of[order][fresh]
                yield pa.RecordBatch.from_arrays([pa.array(name), part["id"].take(pa.array(of)), part["print"].take(pa.array(of))],
                                                 ["name", "id", "print"])

    return run


def _alive_rows(window: int, least: int, with_text: bool):
    """Texts with the windows nothing rules out, as starts and ends of ranges of first words; a text without any is finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, begins in _parts(batch):
                n_texts = len(begins) - 1
                s, of = _symbols(words, begins, least)
                held = part["names"].fill_null([])
                owner = np.repeat(np.arange(n_texts), pc.list_value_length(held).to_numpy(zero_copy_only=False))
                names = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                key = lambda name, text: mix(name.view(np.uint64) + mix(text.astype(np.uint64)))
                alone = ~np.isin(key(s.name, of), key(names, owner))
                low, high = s.low[alone], s.high[alone]
                first = np.maximum(high - window, begins[of[alone]])
                out = first <= low
                ruled = np.bincount(first[out], minlength=len(words) + 1) - np.bincount(low[out] + 1, minlength=len(words) + 1)
                alive = np.cumsum(ruled)[:len(words)] == 0
                text = np.repeat(np.arange(n_texts), np.diff(begins))
                alive &= np.arange(len(words)) + window <= begins[text + 1]
                before, after = np.roll(alive, 1), np.roll(alive, -1)
                begin = np.zeros(len(words) + 1, dtype=bool)
                begin[begins] = True
                starts = np.nonzero(alive & (begin[:-1] | ~before))[0]
                ends = np.nonzero(alive & (begin[1:] | ~after))[0] + 1
                where = text[starts]
                counts = np.bincount(where, minlength=n_texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                from_, to = ((x - begins[where]).astype(np.int32) for x in (starts, ends))
                texts = part["text"].to_pylist()
                digest = [None if c else _digest(t.encode("utf-8", "surrogatepass").split()) for t, c in zip(texts, counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["id"], part["print"], pa.array(np.diff(begins).astype(np.int64)), pa.array(digest, pa.string()),
                     pa.array([t if c or with_text else None for t, c in zip(texts, counts.tolist())], pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(from_)), pa.ListArray.from_arrays(offsets, pa.array(to))],
                    ["doc_id", "id", "print", "n_words", "kept_sha256", "text", "from", "to"])

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, begins in _parts(batch):
                owner = np.repeat(np.arange(len(begins) - 1), pc.list_value_length(part["from"]).to_numpy(zero_copy_only=False))
                from_, to = (part[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("from", "to"))
                size = to - from_
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(from_, size)
                of = np.repeat(owner, size)
                one, two = _window_hashes(words, place + begins[of], window)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), part["id"].take(take), part["print"].take(take), pa.array(place.astype(np.int32))],
                    ["one", "two", "id", "print", "place"])

    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def kept_words(text: str, places: list[int], window: int) -> list[bytes]:
    """Words of ``text`` that no window starting at one of ``places`` covers."""
    words = text.encode("utf-8", "surrogatepass").split()
    change = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.array(places, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    gone = np.cumsum(change)[:len(words)] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _final_rows(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                kept, digests, texts = [], [], []
                for text, places in zip(part["text"].to_pylist(), part["places"].to_pylist()):
                    words = kept_words(text, places or [], window)
                    kept.append(len(words))
                    digests.append(_digest(words))
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass") if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["n_words"], pc.subtract(part["n_words"], pa.array(kept, pa.int64())), pa.array(digests, pa.string()),
                     pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, least: int = LEAST, with_text: bool = False, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row; with ``with_text`` also ``kept``, the words that stay,
    joined by single spaces (of which ``kept_sha256`` is the digest).

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller id. Windows
    are judged on the input. A null or empty text has no words; a null id counts as larger than all others, so such rows lose
    what others have and take nothing from any; rows of one id, repeated or not, take nothing from each other; an empty
    table gives no rows; other columns are not looked at. Texts are read whole; their length is bounded by a task's memory only.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.hash(text).alias("print"), text.alias("text"))
    hashes = F.transform(F.array_remove(F.split("text", SPACES), ""), lambda w: F.xxhash64(w)).alias("hashes")
    names = rows.select("id", "print", hashes).mapInArrow(_symbol_rows(window, least), "name long, id long, print int")
    shared = names.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("name")
    by_text = names.join(shared, "name").groupBy("id", "print").agg(F.collect_set("name").alias("names"))
    judged = rows.join(by_text, ["id", "print"], "left").select("doc_id", "id", "print", "text", hashes, "names")
    judged = stored(judged.mapInArrow(_alive_rows(window, least, with_text), "doc_id long, id long, print int, n_words long, kept_sha256 string, "
                                      "text string, from array<int>, to array<int>"), "windows-left")
    done = judged.where("kept_sha256 IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
                                                          F.array_join(F.array_remove(F.split("text", SPACES), ""), " ").alias("kept"))
    left = judged.where("kept_sha256 IS NULL")
    windows = left.select("id", "print", "from", "to", hashes).mapInArrow(
        _window_rows(window), "one long, two int, id long, print int, place int")
    first = windows.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("z")).where("least < z").drop("z")
    gone = windows.join(first, ["one", "two"]).where("least < id").groupBy("id", "print").agg(F.collect_set("place").alias("places"))
    final = left.join(gone, ["id", "print"], "left").select("doc_id", "n_words", "text", "places").mapInArrow(
        _final_rows(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    every = done.unionAll(final)
    return every if with_text else every.drop("kept")
