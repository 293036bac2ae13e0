import pytest
from pyspark.sql import functions as F

from sheafline.operators import aggregate, anomalies, evidence, facts, profile, quality, questions, trend

INTENTS = {
    "DATA": [
        "Average units per store, please", "List the top regions", "Which product sold the least?", "Is there an outlier in March?",
        "Prediction of next spring's quantity", "Give me a breakdown of null cells", "How many rows and columns came in?"],
    "DOCS": [
        "Where is the code of conduct kept?", "Summarize the travel guideline", "Which protocol covers lost badges?",
        "May I carry over vacation?", "Who signs off compliance exceptions?", "Open the escalation procedure"],
    "HYBRID": [
        "Why did margins shrink according to the policy?", "Compare these results with that document", "Explain the finding using our handbook",
        "What does the policy say about lowest bids?", "Why might a business result be related to some procedure?",
        "Does revenue match what the handbook allows?", "Does the SOP mention a sales forecast?"],
    "GENERAL": ["Hello, what can you do?", "Good morning", "Who are you?", "What is Helper?", "Knock knock", ""],
}


def test_intents(frame):
    rows = [(q, intent) for intent, asked in INTENTS.items() for q in asked]
    labelled = questions.label_intents(frame(rows, "question string, expected string"), assistant_name="Helper").collect()
    assert [(r["question"], r["intent"]) for r in labelled] == rows
    confidence = {r["question"]: r["confidence"] for r in labelled}
    assert (confidence["Good morning"], confidence["What is Helper?"], confidence["Knock knock"]) == (0.98, 0.98, 0.40)
    assert confidence["List the top regions"] == 0.95 and confidence["Why did margins shrink according to the policy?"] == 0.92
    assert all(r["reason"] for r in labelled)


def test_a_greeting_about_business_is_not_general(frame):
    row = questions.label_intents(frame([("Hello, show me the sales",)], "question string")).first()
    assert row["intent"] == "DATA"


def test_words_must_be_whole(frame):
    df = frame([("The summit was minor",), ("résumé of maxé",), ("Sum it up",)], "question string")
    assert [r["intent"] for r in questions.label_intents(df).collect()] == ["GENERAL", "GENERAL", "DATA"]


def test_parameters(frame):
    df = frame([("Top 3 products",), ("top 0",), ("TOP 500 of all",), ("top 99999999999 x",), ("next 6 months by quarter",), ("next 99 days",),
                ("next weeks",), ("yearly",), ("",)], "question string")
    rows = [(r["top_limit"], r["periods"], r["frequency"]) for r in questions.label_parameters(df).collect()]
    assert rows == [(3, 3, None), (1, 3, None), (100, 3, None), (100, 3, None), (5, 6, "quarterly"), (5, 24, "daily"), (5, 3, "weekly"),
                    (5, 3, "yearly"), (5, 3, None)]


DEMO = [("2026-01-10", "Phone", "Electronics", 10, 28000), ("2026-02-10", "Laptop", "Electronics", 4, 14100),
        ("2026-03-10", "Laptop", "Electronics", 2, 7500), ("2026-03-20", "Headphones", "Accessories", 9, 8250)]
DEMO_SCHEMA = "Date string, Product string, Category string, Units long, Revenue long"


@pytest.fixture
def demo(frame):
    return frame(DEMO, DEMO_SCHEMA)


@pytest.fixture
def columns(demo):
    return profile.column_facts(demo)


def test_column_roles(frame):
    rows = [(0, "Order Date", "text", "string"), (1, "overtime", "numeric", "bigint"), (2, "paid", "numeric", "double"), (3, "user_id", "numeric", "int"),
            (4, "amount", "numeric", "double"), (5, "bit", "boolean", "int"), (6, "name", "categorical", "string"), (7, "idle", "numeric", "double")]
    found = questions.column_roles(frame(rows, "ordinal int, name string, semantic_type string, dtype string"))
    assert {r["name"]: r["role"] for r in found.collect()} == {
        "Order Date": "date", "overtime": "date", "paid": "row_id", "user_id": "row_id", "amount": "metric", "bit": "metric",
        "name": "dimension", "idle": "row_id"}


def test_mentions(frame, columns):
    df = frame([("Revenue by product",), ("best selling items",), ("all categories and units",), ("monthly sales",), ("productivity",)], "question string")
    rows = [(r["metrics"], r["dimensions"], r["dates"]) for r in questions.match_columns(df, columns).collect()]
    assert rows == [(["Revenue"], ["Product"], []), (["Revenue"], ["Product"], []), (["Units"], ["Category"], []), (["Revenue"], [], ["Date"]),
                    ([], ["Product"], [])]


@pytest.mark.parametrize("question, expected", [
    ("Which product generated the most revenue?", {"operation": "top", "dimension_column": "Product", "metric_column": "Revenue", "row_limit": 5}),
    ("Show the top 3 categories by units", {"operation": "top", "dimension_column": "Category", "metric_column": "Units", "row_limit": 3}),
    ("average revenue by product", {"operation": "top", "aggregation": "sum"}),
    ("How did revenue change over time by month?", {"operation": "trend", "date_column": "Date", "frequency": "month", "dimension_column": None}),
    ("revenue by day", {"operation": "trend", "frequency": "auto"}),
    ("Which one performed the highest?", {"operation": "ambiguous", "ambiguous": True, "message": questions.NO_DIMENSION, "row_limit": None}),
    ("highest product", {"operation": "ambiguous", "message": "Could not determine which numeric metric to analyze for 'Product'."}),
    ("What are the total figures?", {"operation": "kpis", "metric_column": None, "row_limit": 5}),
    ("Are there unusual revenues?", {"operation": "anomaly", "metric_column": "Revenue", "date_column": "Date", "dimension_column": "Product", "row_limit": 20}),
    ("any outliers?", {"operation": "ambiguous", "message": questions.NO_METRIC["anomaly"]}),
    ("Forecast revenue for the next 3 months", {"operation": "forecast", "periods": 3, "frequency": "monthly", "date_column": "Date"}),
    ("What will revenue look like next year", {"operation": "forecast", "periods": 3, "frequency": "yearly", "row_limit": None}),
    ("unusual forecast of units", {"operation": "anomaly"}),
    ("trend of everything over time", {"operation": "ambiguous", "message": questions.NO_METRIC["trend"]}),
])
def test_operations(frame, columns, question, expected):
    row = questions.label_operations(frame([(question,)], "question string"), columns).first().asDict()
    assert {k: row[k] for k in expected} == expected


def test_operations_without_dates_or_with_one_metric(frame):
    rows = [(0, "Team", "categorical", "string"), (1, "Score", "numeric", "double")]
    held = frame(rows, "ordinal int, name string, semantic_type string, dtype string")
    asked = frame([("forecast it",), ("trend over time",), ("best team highest",), ("any outliers?",)], "question string")
    found = questions.label_operations(asked, held).collect()
    assert [(r["operation"], r["ambiguous"]) for r in found] == [("error", False), ("error", False), ("top", False), ("anomaly", False)]
    assert found[0]["message"] == questions.NO_DATE["forecast"] and found[1]["message"] == questions.NO_DATE["trend"]
    assert found[2]["metric_column"] == "Score" and found[3]["date_column"] is None


def test_labels_are_projections_of_the_questions(frame, columns):
    labelled = questions.label_operations(questions.label_intents(frame([("x",)], "question string")), columns)
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def told(df):
    return [r["fact"] for r in df.orderBy("ord").collect()]


def test_facts_of_a_ranking_and_a_trend(demo):
    ranked = aggregate.top_categories(demo, "Product", "Revenue", limit=3)
    assert told(facts.top_facts(ranked, "Product", "Revenue")) == [
        "Phone generated the most revenue: 28,000.", "Product 'Phone' had Revenue of 28,000.", "Product 'Laptop' had Revenue of 21,600.",
        "Product 'Headphones' had Revenue of 8,250."]
    assert told(facts.trend_facts(trend.time_trend(demo, "Date", "Revenue", frequency="month"), "Revenue")) == [
        "Jan 2026 (2026-01) Revenue: 28,000.", "Feb 2026 (2026-02) Revenue: 14,100.", "Mar 2026 (2026-03) Revenue: 15,750."]


def test_facts_of_a_forecast_and_of_outliers(frame, demo):
    df = trend.forecast_metric(frame([("2023-01-01", 1.5), ("2023-02-01", 2.5), ("2023-03-01", 3.5)], "d string, v double"), "v", "d", 2, "month")
    assert told(facts.forecast_facts(df, "v", 2)) == [
        "Forecasted v for the next 2 month period(s) based on 3 historical observations.",
        "Observed upward linear trend with a slope of 1 per month period.", "Projected v for Apr 2023: 4.5.", "Projected v for May 2023: 5.5."]
    odd = frame([(i, float(10 + i % 3), "a", "x") for i in range(9)] + [(9, 500.0, "2024", "spike")], "i long, v double, d string, c string")
    said = told(facts.anomaly_facts(anomalies.anomaly_summary(odd, "v"), anomalies.detect_anomalies(odd, "v", "d", "c", key="i"), "v"))
    assert said[0] == "Detected 1 statistical anomalies in v (10.0% of 10 observations)."
    assert said[1].startswith("IQR bounds for v: lower bound = ")
    assert said[2] == "Row 9: High outlier in v: 500 (Date: 2024, Category: spike)"


def test_facts_of_kpis_and_quality(demo):
    figures, state = aggregate.kpis(demo), quality.table_quality(demo)
    assert told(facts.kpi_facts(figures))[1] == "Column 'Revenue' Total: 57850.0, Avg: 14462.5, Min: 7500.0, Max: 28000.0."
    assert told(facts.quality_facts(state, "demo.csv")) == [
        "Dataset 'demo.csv' overall health score is 100.0%.", "Missing cells: 0 (0.0%).", "Duplicate rows: 0 (0.0%)."]
    general = told(facts.overview_facts(state, figures, "demo.csv", "How good are Revenue figures?"))
    assert general == ["Dataset 'demo.csv' has 4 rows and 5 columns.", "Data quality health score is 100.0% with 0 missing cells (0.0%).",
                       "Metric 'Revenue': Total=57,850, Avg=14,462.5, Min=7,500, Max=28,000."]
    assert len(told(facts.overview_facts(state, figures, "demo.csv", "anything"))) == 4


def test_answers_join_facts_and_passages(frame):
    asked = frame([("both",), ("data",), ("docs",), ("none",)], "question_id string")
    known = frame([("both", 1, "F2."), ("both", 0, "F1."), ("data", 0, "F1.")], "question_id string, ord long, fact string")
    hits = frame([("both", 2, "b.pdf", 2, " second "), ("both", 1, "a.pdf", 1, "first"), ("docs", 1, "a.pdf", 1, "first"), ("docs", 2, "a.pdf", 1, "again")],
                 "question_id string, rank long, filename string, page int, text string")
    rows = {r["question_id"]: r for r in evidence.synthesize(asked, known, hits).collect()}
    both = rows["both"]
    assert both["data_facts"] == ["F1.", "F2."] and both["citations"] == ["a.pdf (Page 1)", "b.pdf (Page 2)"] and both["warnings"] == []
    assert both["answer"] == (
        "⚡ **Hybrid Synthesis:**\n\n### 📊 DATA FINDINGS\n• F1.\n• F2.\n\n### 📄 DOCUMENT EVIDENCE\n• [a.pdf (Page 1)]:\n  first\n\n"
        "• [b.pdf (Page 2)]:\n  second\n\n### ⚡ AI INTERPRETATION\n" + both["interpretation"]
        + "\n\n### 🔗 CITATIONS\n**Sources:**\n- a.pdf (Page 1)\n- b.pdf (Page 2)")
    assert both["interpretation"].startswith("Based on the structured dataset, F1.; F2.. According to a.pdf (Page 1), the policy")
    assert rows["data"]["interpretation"].startswith("Structured data findings (F1.) were") and "No document citations available." in rows["data"]["answer"]
    assert rows["docs"]["citations"] == ["a.pdf (Page 1)"] and rows["docs"]["warnings"] == [evidence.NO_DATA_WARNING]
    assert rows["none"]["interpretation"] == evidence.NEITHER
    assert rows["none"]["warnings"] == [evidence.NO_DATA_WARNING, evidence.NO_PASSAGE_WARNING]
    given = frame([("data", "📊 **DATA FINDINGS**\n\n* table *")], "question_id string, text string")
    with_text = {r["question_id"]: r["answer"] for r in evidence.synthesize(asked, known, hits, given).collect()}
    assert "### 📊 DATA FINDINGS\n* table *\n\n### 📄" in with_text["data"]
