"""Importance resampling towards a target distribution, with hashed word n-grams.

The bucket of a feature is the CRC-32 of its bytes modulo the number of buckets. CRC is linear: the checksum of a span is the XOR
of one contribution per byte, which depends on the byte and its distance from the span's end only, and of a constant for the
length. So a batch of texts needs one table look-up per byte and one ``bitwise_xor.reduceat`` over the spans of all features; spans
longer than the table are cut into blocks, whose register is folded into the first four bytes of the next block. Buckets are
counted over all rows by one aggregation of at most ``buckets`` sums per task; a document's weight is the mean gain of its features,
and Gumbel noise from a keyed hash turns the highest scores into a weighted draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import give_back, stored, texts

# Distances from the end that the position table holds.
WIDTH = 256
# Bytes of text whose features are worked out together.
BLOCK = 1 << 20


def _position_table() -> np.ndarray:
    """Entry ``distance << 8 | byte``: what a byte adds to a CRC-32 register that starts empty, that far from the end."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = (first >> 1) ^ np.where(first & 1, np.uint32(0xEDB88320), np.uint32(0))
    rows = [first]
    for _ in range(WIDTH - 1):
        rows.append(first[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    return np.concatenate(rows)


TABLE = _position_table()
#: CRC-32 of as many zero bytes: the part of a checksum that the length alone decides.
LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(WIDTH + 1)], dtype=np.uint32)
#: Lower case for A-Z, and which bytes belong to words: digits, letters, and all bytes of characters beyond ASCII.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SPACE = 32


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def crc_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span of at least one byte; spans may overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    # Whole blocks at the end of each span; what is over comes first.
    blocks = (lengths + WIDTH - 1) // WIDTH
    first = lengths - (blocks - 1) * WIDTH
    heads = np.cumsum(blocks) - blocks
    sizes = np.full(int(blocks.sum()), WIDTH, dtype=np.int64)
    sizes[heads] = first
    ends = np.cumsum(sizes)
    distance = np.repeat(ends, sizes) - np.arange(ends[-1]) - 1
    added = TABLE[distance << 8 | data[_gathered(starts, lengths)]]
    parts = np.bitwise_xor.reduceat(added, ends - sizes)
    state = parts[heads] ^ LENGTHS[first]
    rest, step = np.flatnonzero(blocks > 1), 1
    while len(rest):
        register = state[rest] ^ np.uint32(0xFFFFFFFF)
        for j in range(4):  # the register enters the first four bytes of the block
            register_byte = (state[rest] ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8 * j) & np.uint32(0xFF)
            entry = TABLE[(WIDTH - 1 - j) << 8 | register_byte.astype(np.int64)]
            register = entry if j == 0 else register ^ entry
        state[rest] = register ^ parts[heads[rest] + step] ^ np.uint32(0xFFFFFFFF)
        step += 1
        rest = rest[blocks[rest] > step]
    return state


def _features(data: np.ndarray, rows: np.ndarray, order: int, carried: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a stretch of lower-cased bytes, ``rows`` its row per byte.

    The first ``carried`` words were seen before: features inside them alone are left out.
    """
    inside = IN_WORD[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(inside & fresh)
    last = np.ones(len(data), dtype=bool)
    last[:-1] = (rows[1:] != rows[:-1]) | ~inside[1:]
    lengths = np.flatnonzero(inside & last) + 1 - starts
    of_row = rows[starts]
    found_rows, found = [], []
    # Words joined by one space, so that each feature is one span.
    joined = np.full(int(lengths.sum() + len(lengths)), SPACE, dtype=np.uint8)
    at = np.cumsum(lengths + 1) - lengths - 1
    joined[_gathered(at, lengths)] = data[_gathered(starts, lengths)]
    for m in range(1, order + 1):
        left = np.arange(max(0, carried - m + 1), max(0, len(starts) - m + 1))
        left = left[of_row[left] == of_row[left + m - 1]]
        right = left + m - 1
        found_rows.append(of_row[left])
        found.append(crc_of_spans(joined, at[left], at[right] + lengths[right] - at[left]) % np.uint32(buckets))
    return np.concatenate(found_rows), np.concatenate(found).astype(np.int64)


def features(batch: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch and buckets of their features, some ``BLOCK`` bytes of text at a time."""
    batch = batch.cast(pa.large_binary())
    ends = np.frombuffer(batch.buffers()[1], dtype=np.int64)[batch.offset:batch.offset + len(batch) + 1]
    held = batch.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
        part = LOWER[data[ends[at]:ends[upto]]]
        if upto > at + 1 or len(part) <= 2 * BLOCK:
            yield _features(part, np.repeat(np.arange(at, upto), np.diff(ends[at:upto + 1])), order, 0, buckets)
        else:
            yield from _long(part, at, order, buckets)
        at = upto


def _long(part: np.ndarray, row: int, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of one long text in stretches that end between words and begin with the words before."""
    gaps = np.flatnonzero(~IN_WORD[part])
    start, carried = 0, 0
    fresh = 0
    while fresh < len(part):
        stop = np.searchsorted(gaps, fresh + BLOCK)
        end = int(gaps[stop]) + 1 if stop < len(gaps) else len(part)
        stretch = part[start:end]
        yield _features(stretch, np.full(len(stretch), row), order, carried, buckets)
        inside = IN_WORD[stretch]
        firsts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        carried = min(order - 1, len(firsts))
        start = start + int(firsts[-carried]) if carried else end
        fresh = end


def bucket_counts(docs: DataFrame, name: str, order: int, buckets: int, text_column: str = "text") -> DataFrame:
    """``bucket, <name>``: how often the features of all whole texts fall in a bucket; buckets without any have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, found in features(batch.column(0), order, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        give_back()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    rows = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket in thousandths: how much likelier it is in ``target`` than in ``source``.

    Both are tables of at most ``buckets`` rows as :func:`bucket_counts` gives them; ``buckets`` bounds what the driver holds.
    """
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    held = stored(every.join(source, "bucket", "left").join(target, "bucket", "left").select(
        "bucket", *(F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in ("s", "t"))), "buckets")
    both = held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    rise = (F.col("t") + 1) * F.lit(both["all_s"] + buckets) / ((F.col("s") + 1) * F.lit(both["all_t"] + buckets))
    rows = held.select("bucket", F.floor(F.log(rise) * 1000).cast("long").alias("gain")).collect()
    return [gain for _, gain in sorted(map(tuple, rows))]


def weight(text: Column, gain: list[int], order: int) -> Column:
    """``struct<n_features, weight>`` of a text: its features, and the floored mean of their gains (0 without any)."""
    values = np.array(gain, dtype=np.int64)

    @F.arrow_udf("n_features long, weight long")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, total = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for rows, found in features(batch, order, len(values)):
                n += np.bincount(rows, minlength=len(batch))
                np.add.at(total, rows, values[found])
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(total // np.maximum(n, 1))], ["n_features", "weight"])
        give_back()

    return weigh(F.coalesce(text.cast("string"), F.lit("")))


def ranked(scored: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``scored`` with the place of each row in the whole order, from 1.

    One range shuffle deals the rows in order, each task numbers its own, and the sizes of the partitions before it (one number
    per partition) give the rest. The dealt rows are written first, as a repeated sort might cut the ranges elsewhere.
    """
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id())
    held = stored(dealt.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    before, offsets = 0, []
    for task, n in sorted(map(tuple, held.groupBy("_task").agg(F.count("*")).collect())):
        offsets.append((task, before))
        before += n
    sizes = scored.sparkSession.createDataFrame(offsets, "_task int, _before long")
    joined = held.join(F.broadcast(sizes), "_task")
    return joined.withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_task", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, order: int = 1, buckets: int = 10_000, seed: int = 2024,
             least_words: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A draw of ``percent`` in a hundred of the documents, likelier where their features are those of ``target``:
    ``doc_id, n_features, weight, score, rank`` of every document, ``rank`` null where it is not drawn.

    Only documents of at least ``least_words`` words are drawn (with ``order`` 1 their features), the highest scores first, ties to
    the smaller id, then to fewer features. A null or empty text has no features and weight 0; a null id stays null, is hashed as
    the empty text and comes first among ties; repeated rows are scored and drawn each; an empty table gives no rows and an empty
    ``target`` counts as one without features; other columns are not looked at, whatever their names. Very long texts are taken whole.
    """
    rows = texts(docs, id_column, text_column)
    gain = gains(bucket_counts(rows, "s", order, buckets), bucket_counts(target, "t", order, buckets, text_column), buckets)
    made = rows.select(F.col("doc_id").cast("long").alias("doc_id"), weight(F.col("text"), gain, order).alias("_w")).select(
        "doc_id", "_w.n_features", "_w.weight")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    drawn = F.floor(-1000 * F.log(-F.log((noise.cast("double") + 0.5) / 4294967296.0))).cast("long")
    # Written as ranges are cut on a first look at the scores and dealt on a second.
    scored = stored(made.withColumn("score", F.col("weight") + drawn), "scores")
    # The features of a document of n words are n, n - 1, ... runs.
    enough = F.col("n_features") >= sum(max(0, least_words - m) for m in range(order))
    ordered = ranked(scored.withColumn("_enough", enough), [F.desc("_enough"), F.desc("score"), F.asc("doc_id"), F.asc("n_features")])
    n = ordered.where("_enough").count()
    rank = F.when(F.col("_enough") & (F.col("rank") <= percent * n // 100), F.col("rank"))
    return ordered.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
