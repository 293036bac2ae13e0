import math
import random

import numpy as np
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.operators import aggregate, columns, identifiers, quantiles

SALES = [
    ("2026-01-05", "A", "North", 1000.0, 10), ("2026-01-20", "B", "South", 2000.0, 20),
    ("2026-02-03", "A", "North", 1200.0, 12), ("2026-02-14", "C", "East", 800.0, 8),
    ("2026-03-01", "B", "South", 2500.0, 25), ("2026-03-18", "A", "West", 3000.0, 30),
    ("2026-04-02", "A", "North", 1500.0, 15), ("2026-04-25", "C", "East", 500.0, 5),
]
SALES_SCHEMA = "Date string, Product string, Region string, Revenue double, Units long"


@pytest.fixture
def sales(frame):
    return frame(SALES, SALES_SCHEMA)


def values(df, *names):
    return {r[0]: r[1] for r in df.select(*(names or ("category", "value"))).collect()}


def test_statistics_of_a_metric(sales):
    row = aggregate.column_statistics(sales, "revenue").first()
    assert (row["column"], row["count"], row["missing"], row["sum"], row["mean"], row["min"], row["max"], row["median"]) == (
        "Revenue", 8, 0, 12500.0, 1562.5, 500.0, 3000.0, 1350.0)
    assert row["standard_deviation"] == round(float(np.std([r[3] for r in SALES], ddof=1)), 4)


def test_statistics_of_one_value_and_of_none(frame):
    df = frame([(7.0, None), (None, None)], "one double, none double")
    one, none = (aggregate.column_statistics(df, c).first() for c in ("one", "none"))
    assert (one["standard_deviation"], one["missing"], one["median"]) == (0.0, 1, 7.0)
    assert (none["count"], none["sum"], none["min"], none["mean"], none["standard_deviation"]) == (0, 0.0, None, None, None)


def test_sums_and_means_by_category(sales):
    assert values(aggregate.aggregate_by_category(sales, "Product", "Revenue")) == {"A": 6700.0, "B": 4500.0, "C": 1300.0}
    assert values(aggregate.aggregate_by_category(sales, "product", "revenue", " MEAN ")) == {"A": 1675.0, "B": 2250.0, "C": 650.0}


def test_missing_category_and_missing_values(frame):
    df = frame([("a", float("nan")), (None, 1.0), ("Unknown / Missing", 5.0), ("b", None)], "k string, v double")
    rows = sorted((r["category"], r["value"]) for r in aggregate.aggregate_by_category(df, "k", "v").collect())
    assert rows == [("Unknown / Missing", 1.0), ("Unknown / Missing", 5.0), ("a", 0.0), ("b", 0.0)]
    assert values(aggregate.aggregate_by_category(df, "k", None, "count"))["a"] == 1.0
    assert values(aggregate.aggregate_by_category(df, "k", "v", "count"))["a"] == 0.0


def test_sorted_categories_end_with_the_missing_one(frame):
    df = frame([("b", 1.0), (None, 1.0), ("a", 1.0)], "k string, v double")
    assert [r["category"] for r in aggregate.sorted_categories(df, "k", "v").collect()] == ["a", "b", "Unknown / Missing"]


def test_ranking_breaks_ties_by_key_and_puts_missing_last(frame):
    df = frame([("z", 1.0), ("a", 1.0), ("m", None), ("b", 9.0)], "k string, v double")
    top = [(r["rank"], r["category"]) for r in aggregate.top_categories(df, "k", "v", "max").collect()]
    assert top == [(1, "b"), (2, "a"), (3, "z"), (4, "m")]
    bottom = [r["category"] for r in aggregate.bottom_categories(df, "k", "v", "max", 3).collect()]
    assert bottom == ["a", "z", "b"]


def test_top_is_a_prefix_of_the_full_order_and_sums_add_up(frame):
    rng = random.Random(3)
    df = frame([(f"k{rng.randrange(40)}", float(rng.randrange(5))) for _ in range(500)], "k string, v double")
    groups = aggregate.aggregate_by_category(df, "k", "v").collect()
    full = sorted(groups, key=lambda r: (-r["value"], r["category"]))
    top = aggregate.top_categories(df, "k", "v", limit=7).collect()
    assert [r["category"] for r in top] == [r["category"] for r in full[:7]]
    assert sum(r["value"] for r in groups) == df.agg(F.sum("v")).first()[0]


@pytest.mark.parametrize("call, code", [
    (lambda df: aggregate.aggregate_by_category(df, "nope", "Beta"), "INVALID_COLUMN"),
    (lambda df: aggregate.column_statistics(df, "Alpha"), "NON_NUMERIC_COLUMN"),
    (lambda df: aggregate.aggregate_by_category(df, "Alpha", "Beta", "median"), "INVALID_AGGREGATION"),
    (lambda df: aggregate.top_categories(df, "Alpha", "Beta", limit=999), "INVALID_LIMIT"),
    (lambda df: aggregate.bottom_categories(df, "Alpha", "Beta", limit=0), "INVALID_LIMIT"),
    (lambda df: columns.datetime_column(df, "Alpha"), "INVALID_DATETIME_COLUMN"),
    (lambda df: columns.datetime_column(df, "Beta"), "INVALID_DATETIME_COLUMN"),
])
def test_refusals(frame, call, code):
    with pytest.raises(AnalyticsError) as error:
        call(frame([("x", 1), ("y", 2), ("z", 3)], "Alpha string, Beta long"))
    assert error.value.code == code


def test_text_counts_as_numeric_from_seventy_percent(frame):
    df = frame([(v, v if i < 7 else "x") for i, v in enumerate(["1", " 2 ", "3.5", "1e2", "-4", "6", "7", "1d", "1,000", "abc"])],
               "loose string, strict string")
    assert aggregate.column_statistics(df, "strict").first()["count"] == 7
    few = df.filter(~F.col("loose").isin("6", "7"))
    with pytest.raises(AnalyticsError):
        aggregate.column_statistics(few, "loose")
    assert [r["metric"] for r in aggregate.kpis(few).collect()] == ["loose", "strict"]


def test_kpis_skip_identifiers(frame):
    staff = frame([
        (101, "Ann", "Engineering", 120000), (102, "Bo", "Sales", 90000), (103, "Cy", "Engineering", 130000),
        (104, "Di", "HR", 75000), (105, "Ed", "Sales", 90000), (106, "Flo", "Engineering", 110000)],
        "Employee_ID long, Employee string, Department string, Salary long")
    rows = {r["metric"]: r for r in aggregate.kpis(staff).collect()}
    assert rows["Employee_ID"]["excluded"] and rows["Employee_ID"]["total"] is None
    assert (rows["Salary"]["total"], rows["Salary"]["average"], rows["Salary"]["count"]) == (615000.0, 102500.0, 6)
    assert set(rows) == {"Employee_ID", "Salary"}


def test_kpis_of_a_wide_table_and_of_one_without_numbers(frame):
    wide = frame([(i, *[float(20 * m) for m in range(1, 12)]) for i in (10, 20, 30, 40, 50)],
                 "ID_Code long, " + ", ".join(f"Metric_{m} double" for m in range(1, 12)))
    rows = {r["metric"]: r for r in aggregate.kpis(wide).collect()}
    assert len(rows) == 12 and rows["ID_Code"]["excluded"]
    assert all(rows[f"Metric_{m}"]["total"] == 100.0 * m for m in range(1, 12))
    assert aggregate.kpis(frame([("a", "b")], "Department string, Office string")).count() == 0


@pytest.mark.parametrize("name, expected", [
    ("id", True), ("ID_Code", True), ("order id", True), ("customer_ID", True), ("myuuid", True), ("Index", True),
    ("row num", True), ("transactionid", False), ("paid", False), ("pk", True), ("zip", False),
])
def test_identifier_names(name, expected):
    assert identifiers.has_identifier_name(name) is expected


def test_identifier_runs_need_five_different_values_without_gaps(frame):
    df = frame([(3, 1, 1, 1), (1, 2, 2, None), (2, 3, 3, 3), (5, 4, 4, 4), (4, 6, 4, 2)], "run long, gap long, twice long, hole long")
    assert identifiers.identifier_columns(df) == ["run"]
    assert identifiers.identifier_columns(df.limit(4)) == []


SHAPES = {
    "one_hot_value": [5.0] * 400 + [1.0, 2.0, 9.0],
    "negative_and_positive": [float(x) for x in range(-300, 301)],
    "many_scales": [10.0 ** x for x in range(-30, 30)] * 3 + [-(10.0 ** x) for x in range(-5, 20)],
    "tiny_differences": [1.0 + k * 1e-12 for k in range(200)],
    "infinite": [float("-inf"), float("-inf"), 1.0, 2.0, float("inf")],
    "single": [3.25],
    "random": [random.Random(1).gauss(50, 20) for _ in range(2000)],
}


def test_long_runs_with_a_repeat_and_texts_of_integers(spark, frame):
    df = spark.range(-40_000, 60_000).select("id", F.when(F.col("id") == 5, 6).otherwise(F.col("id")).alias("twice"), (F.col("id") * 2).alias("even"))
    assert identifiers.identifier_columns(df.repartition(5)) == ["id"]  # by name
    assert identifiers.identifier_columns(df.withColumnRenamed("id", "run").repartition(5)) == ["run"]
    texts = frame([(f" {i}", str(i * 3), "x" if i == 13 else str(i), 1) for i in range(11, 19)], "number string, gaps string, mixed string, one long")
    assert identifiers.identifier_columns(texts) == [] and identifiers.identifier_columns(texts, read_texts=True) == ["number"]
    assert {r["metric"]: r["excluded"] for r in aggregate.kpis(texts).collect()} == {"number": True, "gaps": False, "mixed": False, "one": False}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_match_a_sorted_list(frame, shape):
    numbers = SHAPES[shape]
    df = frame([(x,) for x in numbers] + [(None,)], "v double").repartition(3)
    probabilities = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = quantiles.exact_quantiles(df, {"v": F.col("v")}, probabilities).first()
    assert found["total"] == len(numbers)
    ordered = sorted(numbers)
    for p, got in zip(probabilities, found["quantiles"]):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        expected = low if low == high else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))
        assert got == pytest.approx(expected, rel=1e-12) or (math.isnan(expected) and math.isnan(got))


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_quantiles_by_group(frame, monkeypatch, broadcast_rows):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(9)
    rows = [("hot", rng.gauss(0, 10)) for _ in range(900)] + [(None, rng.gauss(5, 1)) for _ in range(50)]
    rows += [(f"k{i}", float(i)) for i in range(5)] + [("empty", None)]
    df = frame(rows, "g string, v double").repartition(4)
    metrics = {"v": F.col("v"), "twice": F.col("v") * 2}
    found = quantiles.exact_quantiles(df, metrics, (0.25, 0.5, 0.75), ["g"]).collect()
    got = {(r["g"], r["metric"]): (r["total"], [round(q, 9) for q in r["quantiles"]]) for r in found}
    groups = {g: [v for k, v in rows if k == g] for g, v in rows if v is not None}
    want = {(g, m): (len(v), [round(float(q), 9) for q in np.quantile(np.array(v) * f, (0.25, 0.5, 0.75))])
            for g, v in groups.items() for m, f in (("v", 1), ("twice", 2))}
    assert got == want and len(got) == 14


def test_quantiles_of_several_metrics_take_the_jobs_of_one(spark, frame):
    df = frame([(float(i % 91), -float(i), None if i % 2 else i * 0.5, None) for i in range(700)], "a double, b double, c double, d double").repartition(3).cache()

    def jobs(*names):
        spark.sparkContext.setJobGroup("".join(names), "")
        try:
            found = quantiles.exact_quantiles(df, {n: F.col(n) for n in names}, (0.1, 0.5)).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return {r["metric"]: r["quantiles"] for r in found}, len(spark.sparkContext.statusTracker().getJobIdsForGroup("".join(names)))

    one, few = jobs("a")
    every, many = jobs("a", "b", "c", "d")
    assert many <= few + 2 and every["a"] == one["a"] and set(every) == {"a", "b", "c"}
    for name in "bc":
        assert every[name] == pytest.approx(np.quantile([r[0] for r in df.select(name).dropna().collect()], (0.1, 0.5)))


def test_describe_joins_quartiles_to_every_group(frame):
    df = frame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "g string, v double")
    rows = {r["g"]: (r["count"], r["missing"], r["sum"], r["q25"], r["median"], r["q75"]) for r in aggregate.describe(df, {"v": F.col("v")}, ["g"]).collect()}
    assert rows == {"a": (2, 0, 4.0, 1.5, 2.0, 2.5), None: (1, 0, 5.0, 5.0, 5.0, 5.0), "b": (0, 1, 0.0, None, None, None)}
    assert aggregate.column_statistics(df.filter("g = 'b'"), "v").first()["sum"] == 0.0


def test_ranking_plans_without_a_global_sort(sales):
    plan = aggregate.top_categories(sales, "Product", "Revenue")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
