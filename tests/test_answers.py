"""Facts of planned questions against the single operators, and how the work grows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheafline.operators import aggregate, anomalies, facts, profile, quality, trend
from sheafline.plans import answers


@pytest.fixture(scope="module")
def sales(spark):
    rows = []
    for i in range(400):
        day = dt.datetime(2022, 1, 3, 8) + dt.timedelta(days=2 * i)
        units = None if i % 37 == 5 else (400 if i % 90 == 11 else i % 13)
        rows.append((day, ["Lamp", "Desk", None, "Chair"][i % 4], ["North", "South", "East"][i * i % 3], units, float(i % 50) * 3, 7000 + i))
    return spark.createDataFrame(rows, "`Order Date` timestamp, Product string, Region string, Units long, Revenue double, line_id long").repartition(3).cache()


@pytest.fixture(scope="module")
def columns(sales):
    return profile.column_facts(sales).select("ordinal", "name", "semantic_type", "dtype")


def ask(spark, sales, columns, texts):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id long, question string, run string, plan int").repartition(2)
    asked = asked.withColumnsRenamed({"run": "a.b"})
    found = answers.question_facts(asked, sales, columns, "sales.csv", key="line_id").collect()
    return {texts[r["id"]]: r for r in found}


def said(df):
    return [r["fact"] for r in df.orderBy("ord").collect()]


def test_each_question_gets_the_facts_of_its_operator(spark, sales, columns):
    date = "Order Date"
    kpis = aggregate.kpis(sales)
    checked = quality.table_quality(sales)

    def outliers(metric):
        listed = anomalies.detect_anomalies(sales, metric, date, "Product", key="line_id")
        return said(facts.anomaly_facts(anomalies.anomaly_summary(sales, metric), listed, metric))

    def forecast(metric, periods, frequency):
        return said(facts.forecast_facts(trend.forecast_metric(sales, metric, date, periods, frequency), metric, periods))

    def top(dimension, metric, n):
        return said(facts.top_facts(aggregate.top_categories(sales, dimension, metric, limit=n), dimension, metric))

    wanted = {
        "Show the top 2 products by revenue": top("Product", "Revenue", 2),
        "Which region has the most units?": top("Region", "Units", 5),
        "top 1 region by sales": top("Region", "Revenue", 1),
        "Why did revenue by region drop according to the policy?": top("Region", "Revenue", 5),
        "How did revenue change over time by month?": said(facts.trend_facts(trend.time_trend(sales, date, "Revenue", frequency="month"), "Revenue")),
        "Plot the units timeline by year": said(facts.trend_facts(trend.time_trend(sales, date, "Units", frequency="auto"), "Units")),
        "Forecast revenue for the next 4 months": forecast("Revenue", 4, "month"),
        "Predict units for the next 2 quarters": forecast("Units", 2, "quarter"),
        "What will sales look like next week?": forecast("Revenue", 3, "week"),
        "Are there unusual units?": outliers("Units"),
        "Any outliers in revenue?": outliers("Revenue"),
        "Give me the kpis": said(facts.kpi_facts(kpis)),
        "How good is the data quality?": said(facts.quality_facts(checked, "sales.csv")),
        "What is the average units sold?": said(facts.overview_facts(checked, kpis, "sales.csv", "What is the average units sold?")),
        "What are the totals of all metrics?": said(facts.overview_facts(checked, kpis, "sales.csv", "")),
        # The word for irregular values plans no outliers, so the forecast runs with the columns found for them.
        "Forecast the irregular units next month": forecast("Units", 3, None),
        "Show the top rated of the dataset": [],
        "Are there unusual values?": [],
        "What does the handbook say?": [],
        "Hello!": [],
        "": [],
    }
    got = ask(spark, sales, columns, list(wanted))
    assert len(got) == len(wanted)
    for text, expected in wanted.items():
        assert got[text]["data_facts"] == expected, text
        assert bool(expected) == bool(got[text]["data_facts"])
    assert got["Show the top rated of the dataset"]["message"].startswith("Could not determine which category")
    assert got["Hello!"]["intent"] == "GENERAL" and got["Hello!"]["run"] is None


def test_facts_beyond_the_broadcast_are_joined_in_parts(spark, sales, columns, monkeypatch):
    monkeypatch.setattr(answers, "BROADCAST_BYTES", 0)
    texts = ["Show the top 2 products by revenue", "Give me the kpis", "Hello!"]
    one = ask(spark, sales, columns, texts)
    asked = spark.createDataFrame([(i, texts[i % 3]) for i in range(300)], "id long, question string")
    many = answers.question_facts(asked, sales, columns, "sales.csv", key="line_id").collect()
    assert len(many) == 300
    assert all(r["data_facts"] == one[r["question"]]["data_facts"] for r in many)


def test_jobs_do_not_grow_with_the_questions(spark, sales, columns):
    def jobs(texts, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, question string").coalesce(1)
            answers.question_facts(asked, sales, columns, "sales.csv", key="line_id").collect()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    few = jobs(["Show the top 2 products by revenue", "Which region has the most units?"], "few")
    many = jobs([f"Show the top {1 + i % 90} {('products', 'regions')[i % 2]} by {('units', 'revenue')[i // 2 % 2]}" for i in range(600)], "many")
    assert abs(many - few) <= 3


def test_no_questions_and_an_empty_table(spark, sales, columns):
    nothing = spark.createDataFrame([], "id long, question string")
    assert answers.question_facts(nothing, sales, columns).count() == 0
    empty = sales.where("false")
    asked = spark.createDataFrame([(1, "top 3 products by revenue"), (2, "Forecast units for the next 2 months"), (3, None)], "id long, question string")
    got = {r["id"]: r["data_facts"] for r in answers.question_facts(asked, empty, columns, key="line_id").collect()}
    assert got == {1: [], 2: [], 3: []}


def test_numeric_and_boolean_categories_rank_like_the_operator(spark, columns):
    rows = [(i % 11, i % 2 == 0, float(i % 3)) for i in range(99)]
    df = spark.createDataFrame(rows, "Category long, Segment boolean, Sales double")
    plans = spark.createDataFrame(
        [(f"{d}{n}", "top", "Sales", d, None, n, None, None, None) for d in ("Category", "Segment") for n in (3, 100)],
        "plan_key string, run string, metric string, dimension string, date string, row_limit int, periods int, frequency string, shown array<string>")
    got = answers.run_plans(plans, df, "x")
    for d in ("Category", "Segment"):
        for n in (3, 100):
            best = facts.top_facts(aggregate.top_categories(df, d, "Sales", limit=n), d, "Sales")
            assert said(got.where(F.col("plan_key") == f"{d}{n}")) == said(best)
