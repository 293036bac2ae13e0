"""Samples by hash: exactly the rows wanted, the same with and without thinning."""

from pyspark.sql import functions as F

from sheafline.llm.common import fold, hash_sample


def test_sample_is_that_of_all_rows(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id").repartition(5)
    order = F.xxhash64("doc_id")
    want = {r["doc_id"] for r in df.orderBy(order).limit(100).collect()}
    assert {r["doc_id"] for r in hash_sample(df, 5000, 100, order).collect()} == want
    assert {r["doc_id"] for r in hash_sample(df, 50, 100, order).collect()} == want
    assert hash_sample(df.limit(0), 0, 100, order).count() == 0
    assert hash_sample(df.where("doc_id < 7"), 7, 100, order).count() == 7


def test_folds_are_those_of_the_checksum(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 17, 2**40, -5, None)], "doc_id long")
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", fold("doc_id", 5).alias("f")).collect()}
    assert got == {i: 0 if i is None else zlib.crc32(str(i).encode()) % 5 for i in got}
