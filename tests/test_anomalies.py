import pytest
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.operators import anomalies, cleanup

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def metric(frame):
    return lambda values: frame([(i, v) for i, v in enumerate(values)], "i long, metric double")


def summary(df, **options):
    return anomalies.anomaly_summary(df, "metric", **options).first()


def test_bounds(metric):
    row = summary(metric([float(x) for x in range(10, 90, 10)]))
    assert (row["q1"], row["q3"], row["iqr"], row["lower_bound"], row["upper_bound"]) == (27.5, 62.5, 35.0, -25.0, 115.0)
    assert (row["anomaly_count"], row["normal_count"], row["anomaly_percentage"]) == (0, 8, 0.0)


@pytest.mark.parametrize("values, found", [
    ([10, 12, 14, 15, 16, 18, 20, 22, 500], [(500.0, "high")]),
    ([-500, 10, 12, 14, 15, 16, 18, 20, 22], [(-500.0, "low")]),
    (list(range(10, 21)), []),
    ([42] * 6, []),
    ([10, NAN, 20, NAN], []),
])
def test_outliers(metric, values, found):
    df = metric([float(v) for v in values])
    rows = anomalies.detect_anomalies(df, "metric", key="i").collect()
    assert [(r["value"], r["direction"]) for r in rows] == found


def test_missing_and_infinite_values_are_left_out(metric):
    row = summary(metric([1.0, 2.0, NAN, 3.0, INF, 4.0, 5.0, -INF, 6.0, 7.0, 8.0]))
    assert (row["normal_count"], row["anomaly_count"]) == (8, 0)
    few = summary(metric([10.0, NAN, 20.0, NAN]))
    assert (few["normal_count"], few["q1"], few["upper_bound"], few["iqr"]) == (2, 10.0, 20.0, 0.0)
    none = summary(metric([NAN, None, INF]))
    assert (none["normal_count"], none["q1"], none["upper_bound"], none["anomaly_percentage"]) == (0, 0.0, 0.0, 0.0)


def test_context_of_an_outlier(frame):
    df = frame([("2023-01-01", "a", 100.0), ("2023-02-01", "b", 110.0), ("2023-03-01", None, 105.0), ("2023-04-01", "a", 115.0),
                ("2023-05-01", "Spike", 9999.0), ("2023-06-01", "b", 120.0)], "Date string, Product string, Revenue double")
    row = anomalies.detect_anomalies(df.coalesce(1), "revenue", "date", "PRODUCT").first()
    assert (row["row_index"], row["value"], row["date"], row["category"], row["direction"]) == (4, 9999.0, "2023-05-01", "Spike", "high")


def test_limit_trims_the_list_but_not_the_count(metric):
    df = metric([float(10 + i % 3) for i in range(40)] + [5000.0 + 100 * i for i in range(5)])
    assert summary(df)["anomaly_count"] == 5
    assert [r["value"] for r in anomalies.detect_anomalies(df, "metric", limit=2, key="i").collect()] == [5400.0, 5300.0]
    for limit in (0, 1001):
        with pytest.raises(AnalyticsError, match="INVALID_LIMIT"):
            anomalies.detect_anomalies(df, "metric", limit=limit)
    with pytest.raises(AnalyticsError, match="EMPTY_DATASET"):
        anomalies.anomaly_summary(df.limit(0), "metric")


def test_groups_have_their_own_bounds(frame):
    data = [("hot", float(i % 7)) for i in range(300)] + [("hot", 50.0)] + [("cold", 1000.0 + i) for i in range(9)] + [(None, 5.0)] * 5 + [(None, 99.0)]
    df = frame([(i, *r) for i, r in enumerate(data)], "i long, g string, metric double")
    found = anomalies.flag_anomalies(df, "metric", by=["g"], key="i").collect()
    assert sorted((str(r["g"]), r["value"]) for r in found) == [("None", 99.0), ("hot", 50.0)]
    totals = {r["g"]: (r["normal_count"], r["anomaly_count"]) for r in anomalies.anomaly_summary(df, "metric", ["g"]).collect()}
    assert totals == {"hot": (300, 1), "cold": (9, 0), None: (5, 1)}


def test_row_index_is_gap_free_in_storage_order(spark):
    df = spark.range(1000, numPartitions=7).filter("id % 3 != 0")
    rows = cleanup.with_row_index(df).orderBy("id").collect()
    assert [r["row_index"] for r in rows] == list(range(666))


def test_result_does_not_depend_on_partitioning(metric):
    df = metric([float((i * 37) % 101) for i in range(400)] + [999.0, -999.0])
    a, b = (anomalies.anomaly_summary(df.repartition(n), "metric").first() for n in (1, 8))
    assert a == b
    assert a["anomaly_count"] + a["normal_count"] == df.count()


def test_bounds_are_a_constant_of_the_filter(metric):
    plan = anomalies.flag_anomalies(metric([1.0, 2.0, 3.0, 4.0, 99.0]), "metric", key="i")._jdf.queryExecution().toString()
    assert "scalar-subquery" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert F is not None


def test_a_hot_value_of_a_hot_group_is_spread(spark):
    rows = spark.range(60_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('g', id % 997) END AS g",
                                          "CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 5000 = 4 THEN 1e6D ELSE double(id % 90) END AS v")
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for n, v in zip(before, ("false", "-1", "16")):
        spark.conf.set(n, v)
    try:
        bounds = anomalies.iqr_bounds(rows, "v", ["g"]).cache()
        found = anomalies._with_bounds(rows, F.col("v"), ["g"], bounds)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 60_000 and len(sizes) == 16 and max(sizes) < 2 * 60_000 / 16
        flagged = anomalies.flag_anomalies(rows, "v", by=["g"], key="id", bounds=bounds).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    held = {r["g"]: r for r in bounds.collect()}
    assert None in held and len(flagged) == sum(
        not held[r["g"]]["lower_bound"] <= r["v"] <= held[r["g"]]["upper_bound"] for r in rows.collect()) > 0


def test_row_numbers_come_from_the_files_where_they_can(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(1000).repartition(7).write.parquet(path)
    held = spark.read.parquet(path)
    copies = []
    monkeypatch.setattr(cleanup, "cut_lineage", lambda df: copies.append(df) or df.cache())
    for most in (100, 1):
        monkeypatch.setattr(cleanup, "BROADCAST_FILES", most)
        numbered = cleanup.with_row_index(held.select("id", (F.col("id") * 2).alias("twice")))
        rows = numbered.orderBy("row_index").collect()
        assert numbered.columns == ["id", "twice", "row_index"] and [r["row_index"] for r in rows] == list(range(1000)) and not copies
        by_file = {r["id"]: r["f"] for r in held.select("id", F.col("_metadata.file_path").alias("f")).collect()}
        assert [by_file[r["id"]] for r in rows] == sorted(by_file.values())
    # A part of the rows, and rows that are in no file, are numbered from a copy.
    part = cleanup.with_row_index(held.where("id % 3 = 0")).collect()
    assert sorted(r["row_index"] for r in part) == list(range(334)) and len(copies) == 1
    assert sorted(r["row_index"] for r in cleanup.with_row_index(held.groupBy("id").count()).collect()) == list(range(1000)) and len(copies) == 2
    assert cleanup.with_row_index(held.where("false")).count() == 0
