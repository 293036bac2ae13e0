import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.operators import trend
from sheafline.streaming import ingest
from sheafline.streaming.ingest import ingest_batch, stream_documents
from sheafline.streaming.trend import stream_trend

DOCS = "document_id long, filename string, text string"


def test_documents_stream_in_once(spark, frame, tmp_path):
    source, catalog, chunks, log = (str(tmp_path / n) for n in ("in", "catalog", "chunks", "log"))
    frame([(1, "a", "alpha text"), (2, "b", "beta"), (3, "c", "alpha text")], DOCS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(source)
    stream_documents(stream, catalog, chunks, log).awaitTermination()
    frame([(4, "d", "beta"), (5, "e", "gamma " * 500)], DOCS).coalesce(1).write.mode("append").parquet(source)
    stream_documents(stream, catalog, chunks, log).awaitTermination()
    held = spark.read.parquet(catalog)
    assert sorted(r["document_id"] for r in held.collect()) == [1, 2, 5]
    pieces = spark.read.parquet(chunks)
    assert {r["document_id"]: r["count"] for r in pieces.groupBy("document_id").count().collect()} == {1: 1, 2: 1, 5: 4}


def test_a_repeated_batch_changes_nothing(spark, frame, tmp_path):
    catalog, chunks = str(tmp_path / "catalog"), str(tmp_path / "chunks")
    first = frame([(1, "a", "x"), (2, "b", "y")], DOCS)
    second = frame([(3, "c", "y"), (4, "d", "z")], DOCS)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        ingest_batch(batch, number, catalog, chunks)
    rows = sorted((r["document_id"], r["batch_id"]) for r in spark.read.parquet(catalog).collect())
    assert rows == [(1, 0), (2, 0), (4, 1)]
    assert spark.read.parquet(chunks).count() == 3


def test_copies_across_batches_resolve_to_the_first_and_any_batch_can_be_repeated(spark, frame, tmp_path):
    texts = ["alpha", "beta", "gamma", "delta", "alpha beta"]
    batches = [[(10 * b + i, f"f{i}", texts[(b * i + i) % (b + 1)]) for i in range(6)] + [(1000 + b, "none", None)] for b in range(5)]
    catalog, chunks, resolved = (str(tmp_path / n) for n in ("catalog", "chunks", "resolved"))

    def tables():
        held = sorted((r["document_id"], r["content_hash"], r["size"], r["batch_id"]) for r in spark.read.parquet(catalog).collect())
        cut = sorted((r["document_id"], r["text"], r["batch_id"]) for r in spark.read.parquet(chunks).collect())
        told = sorted((r["document_id"], r["resolved_id"], r["is_duplicate"], r["batch_id"]) for r in spark.read.parquet(resolved).collect())
        return held, cut, told

    for b, rows in enumerate(batches):
        ingest_batch(frame(rows, DOCS), b, catalog, chunks, resolved_path=resolved)
    first, want, told = {}, [], []
    for b, rows in enumerate(batches):
        for i, _, text in sorted(r for r in rows if r[2] is not None):
            if text not in first:
                first[text] = i
                want.append((i, text, b))
        told += [(i, first[text], i != first[text], b) for i, _, text in rows if text is not None]
    once = tables()
    assert once[1] == sorted(want) and once[2] == sorted(told) and [r[0] for r in once[0]] == [r[0] for r in sorted(want)]
    for b in (4, 0, 2):
        ingest_batch(frame(batches[b], DOCS), b, catalog, chunks, resolved_path=resolved)
    assert tables() == once


def test_a_batch_reads_its_own_prefixes_of_the_catalog_only(spark, frame, tmp_path):
    catalog, chunks = str(tmp_path / "catalog"), str(tmp_path / "chunks")
    ingest_batch(frame([(i, "f", f"text {i}") for i in range(300)], DOCS), 0, catalog, chunks)
    held = ingest.open_catalog(spark, catalog)
    assert held.select("prefix").distinct().count() == 16
    one = held.where(F.col("prefix").isin(["a"]) & (F.col("batch_id") < 1))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*prefix", plan) and all(h.startswith("a") for h, in one.select("content_hash").collect())
    ingest_batch(frame([(900, "g", "text 17"), (901, "g", "new")], DOCS), 1, catalog, chunks)
    assert sorted(r["document_id"] for r in spark.read.parquet(catalog).where("batch_id = 1").collect()) == [901]


def test_daily_totals_leave_once_they_are_final(spark, frame, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=h), ["a", "b"][h % 2], float(h)) for h in range(0, 24 * 9, 5)]
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    frame(rows, "ts timestamp_ntz, k string, v double").write.parquet(source)
    for i, (frequency, by) in enumerate((("day", ["k"]), ("week", []))):
        stream = spark.readStream.schema("ts timestamp_ntz, k string, v double").parquet(source)
        totals = stream_trend(stream, "TS", "v", frequency=frequency, by=by)
        schema = totals.schema
        totals.writeStream.format("parquet").option("path", out + str(i)).option("checkpointLocation", log + str(i)).trigger(
            availableNow=True).start().awaitTermination()
        got = sorted(tuple(r) for r in spark.read.schema(schema).parquet(out + str(i)).collect())
        batch = sorted(tuple(r) for r in trend.time_trend(spark.read.parquet(source), "ts", "v", frequency=frequency, by=by).select(*schema.names).collect())
        final = [r for r in batch if (r[-2] < "2024-01-09" if frequency == "day" else r[-2] == "2024-W01")]
        assert got == final and got


@pytest.mark.parametrize("frequency, aggregation, by", [("month", "sum", ["k"]), ("quarter", "mean", []), ("year", "max", ["k"]), ("month", "count", [])])
def test_calendar_periods_leave_once_they_are_final(spark, frame, tmp_path, frequency, aggregation, by):
    start = dt.datetime(2023, 11, 20)
    rows = [(start + dt.timedelta(hours=h), [None, "a", "b.\"c\""][h % 3], None if h % 11 == 0 else float(h % 97)) for h in range(0, 24 * 130, 17)]
    schema = "ts timestamp_ntz, k string, v double"
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for part in (rows[:60], rows[60:61], rows[61:]):  # three micro-batches
        frame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        totals = stream_trend(stream, "ts", "v", aggregation, frequency, by=by)
        totals.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(totals.schema).parquet(out).collect()
    batch = trend.time_trend(frame(rows, schema), "ts", "v", aggregation, frequency, by=by).select(*totals.columns).collect()
    final = [tuple(r) for r in batch if r["period"] < {"month": "2024-03", "quarter": "2024-Q1", "year": "2024"}[frequency]]
    assert sorted(map(tuple, got), key=repr) == sorted(final, key=repr) and got


def test_rows_too_late_for_their_month_are_dropped(spark, frame, tmp_path):
    schema = "ts timestamp, v double"
    at = lambda *d: dt.datetime(2024, *d)
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    # An hour into February a row of January is still in time; after three hours it is not.
    for part in ([(at(1, 5), 1.0), (at(2, 1, 1), 10.0)], [(at(1, 31, 23, 30), 2.0)], [(at(2, 1, 3), 20.0)], [(at(1, 31, 23, 40), 4.0)], [(at(3, 2), 40.0)], [(at(4, 2), 80.0)]):
        frame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        totals = stream_trend(stream, "ts", "v", frequency="month")
        totals.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(totals.schema).parquet(out).collect()))
    assert got == [("2024-01", 3.0), ("2024-02", 30.0), ("2024-03", 40.0)]


def test_streams_know_their_frequencies(spark):
    with pytest.raises(AnalyticsError, match="INVALID_FREQUENCY"):
        stream_trend(spark.range(1).selectExpr("current_timestamp() as ts", "1.0D as v"), "ts", "v", frequency="auto")
