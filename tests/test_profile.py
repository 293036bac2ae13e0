import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheafline.operators import profile, quality
from sheafline.plans import profile as profiles
from test_aggregate import SALES, SALES_SCHEMA

MESSY = [(1, "A", "FIXED", None), (2, "B", "FIXED", None), (2, "B", "FIXED", None), (4, None, "FIXED", None),
         (5, "E", "FIXED", None), (5, "E", "FIXED", None)]


@pytest.fixture
def messy(frame):
    return frame(MESSY, "ID long, Category string, Constant string, EmptyCol string")


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_quality_of_a_messy_table(messy):
    row = quality.table_quality(messy).first()
    assert (row["missing_cells"], row["missing_percentage"], row["duplicate_rows"], row["duplicate_percentage"]) == (7, 29.17, 2, 33.33)
    assert (row["empty_rows"], row["empty_columns"], row["constant_columns"], row["score"]) == (0, 1, 1, 68.0)
    assert row["columns_with_missing"] == ["Category", "EmptyCol"] and row["columns_with_missing_count"] == 2


def test_quality_of_a_clean_table_and_of_one_without_rows(frame):
    clean = quality.table_quality(frame(SALES, SALES_SCHEMA)).first()
    assert (clean["score"], clean["missing_cells"], clean["duplicate_rows"]) == (100.0, 0, 0)
    empty = quality.table_quality(frame([], "a long, b string")).first()
    assert (empty["rows"], empty["missing_percentage"], empty["duplicate_percentage"], empty["empty_columns"], empty["score"]) == (0, 0.0, 0.0, 2, 90.0)


def test_score_is_clamped(frame):
    row = quality.table_quality(frame([(None, None)] * 30, "a string, b string")).first()
    assert row["score"] == 0.0 and row["empty_rows"] == 30


def test_nan_counts_as_missing_and_nested_values_can_be_compared(frame):
    df = frame([(float("nan"), [1], {"a": 1}), (1.0, [1], {"a": 1}), (1.0, [1], {"a": 1})], "x double, y array<int>, z map<string,int>")
    row = quality.table_quality(df).first()
    assert (row["missing_cells"], row["duplicate_rows"], row["constant_columns"]) == (1, 1, 3)


def test_duplicates_and_distinct_rows_add_up(frame):
    long = "x" * 5000
    df = frame([(long,), (long,), (long + "y",), (None,), (None,), ("#" + "0" * 64,)], "t string").repartition(3)
    row = quality.duplicate_summary(df).first()
    assert (row["rows"], row["distinct_rows"], row["duplicate_rows"]) == (6, 4, 2)


def test_plain_checks_need_no_expand(messy):
    assert "Expand" not in quality.cell_summary(messy)._jdf.queryExecution().toString()


def test_semantic_types(frame):
    rows = [(True, 1, 1.5, "2024-01-0%d" % (i % 9 + 1), "x", f"text {i} " * 3, None, dt.datetime(2024, 1, 1), "n/a" if i < 15 else "2024-01-01")
            for i in range(60)]
    df = frame(rows, "flag boolean, bit long, num double, created string, cat string, txt string, none string, at timestamp_ntz, some_day string")
    types = {n: r["semantic_type"] for n, r in by_name(profile.column_facts(df)).items()}
    assert types == {"flag": "boolean", "bit": "boolean", "num": "numeric", "created": "datetime", "cat": "categorical", "txt": "text",
                     "none": "unknown", "at": "datetime", "some_day": "categorical"}


def test_category_thresholds(frame):
    df = frame([(f"v{i % 51}", f"v{i % 50}") for i in range(204)], "a string, b string")
    assert {n: r["semantic_type"] for n, r in by_name(profile.column_facts(df)).items()} == {"a": "text", "b": "categorical"}
    more = frame([(f"v{i % 51}",) for i in range(205)], "a string")
    assert profile.column_facts(more).first()["semantic_type"] == "categorical"


def test_column_profile(frame):
    rows = by_name(profile.profile_columns(frame(SALES, SALES_SCHEMA).coalesce(1)))
    assert [rows[c]["semantic_type"] for c in ("Date", "Product", "Region", "Revenue", "Units")] == [
        "datetime", "categorical", "categorical", "numeric", "numeric"]
    assert (rows["Date"]["min_date"], rows["Date"]["max_date"], rows["Date"]["range_days"]) == ("2026-01-05T00:00:00", "2026-04-25T00:00:00", 110)
    assert [(v["value"], v["count"]) for v in rows["Product"]["top_values"]] == [("A", 4), ("B", 2), ("C", 2)]
    assert rows["Revenue"]["sample_values"] == ["1000.0", "2000.0", "1200.0", "800.0", "2500.0"]
    revenue = rows["Revenue"]
    assert (revenue["min"], revenue["max"], revenue["mean"], revenue["median"], revenue["q25"], revenue["q75"]) == (
        500.0, 3000.0, 1562.5, 1350.0, 950.0, 2125.0)
    assert rows["Revenue"]["top_values"] is None and rows["Product"]["mean"] is None


def test_numeric_profile_of_one_value_and_flags(frame):
    df = frame([(5.0, 1, True), (None, 0, True), (None, 1, None)], "one double, bit int, flag boolean")
    rows = by_name(profile.profile_columns(df.coalesce(1)))
    assert (rows["one"]["std"], rows["one"]["q25"], rows["one"]["q75"], rows["one"]["median"]) == (0.0, None, None, 5.0)
    assert [(v["value"], v["count"]) for v in rows["bit"]["top_values"]] == [("1", 2), ("0", 1)]
    assert [(v["value"], v["count"]) for v in rows["flag"]["top_values"]] == [("True", 2)]
    assert rows["bit"]["semantic_type"] == "boolean" and rows["bit"]["mean"] is None


def test_top_values_of_long_texts(frame):
    long = "w" * 500
    df = frame([(long,)] * 3 + [("short",)] * 2 + [(f"{i:03d}" * 40,) for i in range(5)], "t string").repartition(4)
    rows = profile.top_values(df, ["t"], 3).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in rows[:2]] == [(long, 3), ("short", 2)]
    assert len(rows[2]["value"]) == 120


def test_samples_of_a_sparse_column(spark):
    df = spark.range(200).select(F.when(F.col("id") >= 190, F.col("id")).alias("late"), F.lit(None).cast("string").alias("never"))
    assert profile.sample_values(df.coalesce(1)) == {"late": ["190", "191", "192", "193", "194"], "never": []}


def test_distinct_counts_exact_and_approximate(messy):
    exact = {r["name"]: r["unique_count"] for r in profile.distinct_counts(messy).collect()}
    assert exact == {"ID": 4, "Category": 3, "Constant": 1, "EmptyCol": 0}
    assert exact == {r["name"]: r["unique_count"] for r in profile.distinct_counts(messy, approx=True).collect()}


def test_summary_metrics_and_defaults(frame):
    df = frame([(i, *r, "t") for i, r in enumerate(SALES)], "row_id long, " + SALES_SCHEMA + ", note string")
    made = profiles.profile_table(df, "d1", "sales.csv", "2026-05-01T00:00:00Z", "csv", 10)
    row = profiles.table_summary(made).first()
    assert (row["row_count"], row["column_count"], row["quality_score"]) == (8, 7, 98.0)
    assert row["numeric_columns"] == ["row_id", "Revenue", "Units"] and row["datetime_columns"] == ["Date"]
    assert row["categorical_columns"] == ["Product", "Region", "note"] and row["text_columns"] == []
    assert [r["name"] for r in profiles.business_metrics(made.columns).orderBy("ordinal").collect()] == ["Revenue", "Units"]
    assert profiles.default_columns(made.columns).first().asDict() == {"metric": "Revenue", "category": "Product", "date": "Date"}
    only_ids = profiles.profile_table(df.select("row_id"), "d2")
    assert profiles.default_columns(only_ids.columns).first().asDict() == {"metric": "row_id", "category": None, "date": None}
