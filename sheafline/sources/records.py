"""CSV records whose cells hold line ends, found in parallel by the parity of quotes.

A line end belongs to a cell when an odd number of quotes stands before it in the file. Every split of a file reports the parity of
its quotes, a prefix over the splits of a file says which of them begin inside a cell, and then each task joins the lines of its
splits into records on its own. Only the two ends of a split that may belong to a record across splits travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError

# Splits that begin inside a cell are broadcast up to this many; beyond it their lines are dealt by split.
BROADCAST_SPLITS = 1_000_000
WHOLE, HEAD, TAIL, THROUGH = range(4)


def quotes_in(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit('"'), F.lit("")))


def decoded(line: Column, encoding: str) -> Column:
    """The text of a line that was read as it is."""
    return line if encoding == "UTF-8" else F.decode(line.cast("binary"), encoding)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``(file, at, inside, value)`` in order to records and ends ``(file, at, ordinal, kind, value)``.

    Records that begin in the split are numbered, blank lines between them are passed over.
    """
    now, waiting, began_inside, seen, parity = None, [], False, 0, 0

    def rows(kind: int, values: pa.Array, ordinals: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, now[0])), pa.array(np.full(n, now[1])), pa.array(ordinals.astype(np.int64)), pa.array(np.full(n, kind, dtype=np.int32)), values],
            names=["file", "at", "ordinal", "kind", "value"])

    def left_over() -> Iterator[pa.RecordBatch]:
        if waiting:
            yield rows(THROUGH if began_inside else TAIL, pa.array(["\n".join(waiting)]), np.array([seen]))

    for batch in batches:
        values = batch.column(3).cast(pa.large_string())
        files, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (places[1:] != places[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if start == end:
                continue
            if now != (files[start], places[start]):
                yield from left_over()
                now, waiting, seen = (files[start], places[start]), [], 0
                began_inside = bool(batch.column(2)[start].as_py())
                parity = int(began_inside)
            lines = values.slice(start, end - start)
            after = (parity + np.cumsum(pc.count_substring(lines, '"').to_numpy())) & 1
            parity = int(after[-1])
            closing = np.flatnonzero(after == 0) + 1
            if not len(closing):
                waiting += lines.to_pylist()
                continue
            bounds = pa.array(np.concatenate([[0], closing]), pa.int64())
            records = pc.binary_join(pa.LargeListArray.from_arrays(bounds, lines.slice(0, closing[-1])), pa.scalar("\n", pa.large_string())).cast(pa.string())
            if waiting or began_inside:
                first = "\n".join([*waiting, records[0].as_py()])
                if began_inside:
                    yield rows(HEAD, pa.array([first]), np.array([-1]))
                    records = records.slice(1)
                else:
                    records = pa.concat_arrays([pa.array([first]), records.slice(1)])
                began_inside = False
            waiting = lines.slice(closing[-1]).to_pylist()
            records = records.filter(pc.not_equal(pc.utf8_trim_whitespace(records), ""))
            yield rows(WHOLE, records, seen + np.arange(len(records)))
            seen += len(records)
    if now is not None:
        yield from left_over()


def quoted_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(first, ordinal, value)``: one row per record of the CSV files at ``path``, blank lines left out.

    ``ordinal`` counts the records that begin in a split, and ``first`` says that the split begins its file. Lines end with a
    line feed, or with a carriage return and a line feed. A file whose last quote is never closed is refused with
    ``DATASET_LOAD_ERROR``. A record is held by one task; its length is bounded by the quotes around its cells only.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                       decoded(F.col("value"), encoding).alias("value"))
    parity = lines.groupBy("file", "at").agg((F.sum(quotes_in(F.col("value"))) % 2).alias("odd"))
    # A row per split of a file.
    in_file = Window.partitionBy("file").orderBy("at")
    before = F.coalesce(F.sum("odd").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    all_odd = F.sum("odd").over(Window.partitionBy("file")) % 2 == 1
    splits = parity.select("file", "at", before.alias("inside"), all_odd.alias("open"))
    inside, open_files = splits.agg(F.count_if("inside"), F.count_if("open")).first()
    if open_files:
        raise AnalyticsError("DATASET_LOAD_ERROR", "A quote is never closed.")
    if not inside:
        told = lines.select("file", "at", F.lit(False).alias("inside"), "value")
    else:
        known = splits.where("inside").select("file", "at", "inside")
        if inside <= BROADCAST_SPLITS:
            joined = lines.join(F.broadcast(known), ["file", "at"], "left")
        else:
            placed = lines.withColumn("_i", F.monotonically_increasing_id())
            joined = placed.hint("shuffle_hash").join(known, ["file", "at"], "left").repartition("file", "at").sortWithinPartitions("file", "at", "_i")
        told = joined.select("file", "at", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    parts = told.mapInArrow(_joined, "file long, at long, ordinal long, kind int, value string")
    whole = parts.where(F.col("kind") == WHOLE)
    if inside:
        ends = parts.where(F.col("kind") != WHOLE)
        # At most two rows per split: an end goes with the last record that began before it.
        began = F.max(F.when(F.col("kind") == TAIL, F.col("at"))).over(
            Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        grouped = ends.withColumn("_began", began).groupBy("file", F.col("_began").alias("at")).agg(
            F.max(F.when(F.col("kind") == TAIL, F.col("ordinal"))).alias("ordinal"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("at").alias("a"), F.col("kind").alias("k"), "value"))), lambda e: e["value"]), "\n").alias("value"))
        whole = whole.select("file", "at", "ordinal", "value").unionByName(grouped)
    return whole.select((F.col("at") == 0).alias("first"), "ordinal", F.regexp_replace("value", r"\r\z", "").alias("value"))


def first_records(spark: SparkSession, path: str, encoding: str, count: int, quoted: bool) -> list[str]:
    """The first ``count`` records of a file, without reading much further."""
    lines = spark.read.option("lineSep", "\n").text(path) if quoted else spark.read.text(path)
    texts = lines.select(decoded(F.col("value"), encoding).alias("value"))
    taken = max(8, count)
    while True:
        found = [row[0] for row in texts.take(taken)]
        records: list[str] = []
        waiting: list[str] = []
        for line in found:
            waiting.append(line)
            if not quoted or "\n".join(waiting).count('"') % 2 == 0:
                record, waiting = "\n".join(waiting).removesuffix("\r"), []
                if record.strip():
                    records.append(record.lstrip("﻿") if not records else record)
        if len(records) >= count or len(found) < taken:
            return records[:count]
        taken *= 8
