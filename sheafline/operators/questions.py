"""Labelling tables of questions: intent, analysis, parameters and the columns they mention."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError

# ---------------------------------------------------------------------------------------------
# The words and patterns that decide an intent. All are matched in lower case.
# ---------------------------------------------------------------------------------------------
GREETING_PATTERNS = (
    r"^(hi|hello|hey|greetings|good\s+(morning|afternoon|evening))\b",
    r"\b(who are you|what are you|what can you do|how do you work|help me|capabilities)\b",
    r"^what is this (app|tool|system|platform)\b",
)
BUSINESS_WORDS = ("salary", "sales", "policy", "handbook", "revenue", "dataset")
DATA_KEYWORDS = (
    "sales", "revenue", "salary", "salaries", "profit", "dataset", "rows", "columns", "data quality",
    "missing values", "null", "kpi", "kpis", "metrics", "average", "avg", "total", "sum", "mean", "median",
    "minimum", "maximum", "min", "max", "highest", "lowest", "top", "bottom", "trend", "how many employees",
    "most", "least", "generated", "units", "quantity", "breakdown", "product", "products", "category",
    "categories", "unusual", "anomaly", "anomalies", "outlier", "outliers", "abnormal", "forecast", "predict",
    "prediction", "projected", "projection", "future",
)
DOCS_KEYWORDS = (
    "policy", "handbook", "sop", "procedure", "procedures", "guideline", "guidelines", "protocol",
    "security policy", "acceptable use", "code of conduct", "incident response", "incident reporting",
    "escalation", "vacation", "leave policy", "compliance", "employee handbook", "what does the",
    "according to the policy",
)
HYBRID_PATTERNS = (
    r"why did .+ according to the policy",
    r"compare .+ (findings|results?) with .+ (policy|document)",
    r"explain .+ (result|finding|metric) using .+ (document|policy|handbook)",
    r"what does the (handbook|policy) say about .+ (lowest|highest|salary|sales|employee)",
    r"why might .+ (business result|sales|metric) be related to .+ (policy|handbook|procedure)",
)
CONFIDENCE = {"greeting": 0.98, "HYBRID": 0.92, "DATA": 0.95, "DOCS": 0.95, "unknown": 0.40}
REASONS = {
    "greeting": "greeting or general capability question",
    "HYBRID": "query cross-references structured data metrics with document evidence",
    "DATA": "query targets tabular dataset statistics/metrics",
    "DOCS": "query asks for policies, SOPs, or textual document knowledge",
    "unknown": "classification uncertain",
}

# The words that decide an analysis; found anywhere in the lower-cased question.
ANOMALY_WORDS = (
    "unusual", "anomaly", "anomalies", "outlier", "outliers", "abnormal", "irregular", "deviat",
)
# The words that ask for the KPIs, for the quality, and (fewer than above) for anomalies of a table as a whole.
KPI_WORDS = ("kpi", "kpis", "key performance indicator")
QUALITY_WORDS = ("data quality", "quality score", "missing value", "missing values", "health score", "how good is my data")
ANOMALY_TOOL_WORDS = ("unusual", "anomaly", "anomalies", "outlier", "outliers", "abnormal")
FORECAST_WORDS = (
    "forecast", "predict", "prediction", "projected", "projection", "future", "look like next",
)
TREND_WORDS = (
    "trend", "over time", "by month", "monthly", "by year", "yearly", "by day", "daily", "across months",
    "over the months", "change over time", "plot over time", "timeline", "how did",
)
TREND_CONTEXT = ("trend", "time", "month", "year", "day", "change", "over time")
TOP_WORDS = (
    "most", "highest", "top", "best selling", "maximum", "greatest", "leader", "lead", "rank", "ranking",
)
BREAKDOWN_WORDS = (
    "by product", "by category", "by department", "by region", "per product", "per category", "revenue by",
    "sales by", "breakdown by",
)
BREAKDOWN_PATTERN = r"\b(revenue|sales|units|quantity|salary|cost)\s+by\s+\w+"
MONTHLY_WORDS = ("month", "monthly", "trend", "over time")
DATE_WORDS = (
    "date", "time", "month", "monthly", "trend", "year", "yearly", "day", "daily", "timeline", "over time",
)
NEXT_PERIODS = r"\bnext\s+(?:\d+\s+)?(?:month|quarter|year|week|day)s?\b"
NEXT_COUNT = r"\bnext\s+(\d+)\s+(?:month|quarter|year|week|day)s?\b"
TOP_COUNT = r"\btop\s+(\d+)\b"
# In order of precedence.
FREQUENCY_WORDS = (
    ("quarter", "quarterly"), ("month", "monthly"), ("year", "yearly"), ("week", "weekly"), ("day", "daily"),
)
# Column names that stand for one another, with the question words that mean any of them.
METRIC_SYNONYMS = (
    (("revenue", "sales", "turnover"), ("revenue", "revenues", "sales", "turnover", "selling")),
    (("units", "quantity", "volume"), ("unit", "units", "quantity", "volume")),
    (("salary", "compensation", "pay", "wage"), ("salary", "salaries", "compensation", "pay", "wage")),
    (("cost", "expense", "spend"), ("cost", "costs", "expense", "expenses", "spend")),
)
DIMENSION_SYNONYMS = (
    (("product", "item"), ("product", "products", "item", "items", "selling")),
    (("category", "type", "segment"), ("category", "categories", "type", "segment")),
    (("department", "dept"), ("department", "departments", "dept")),
    (("region", "territory", "location"), ("region", "regions", "territory", "location")),
)
DATE_NAME_HINTS = ("date", "timestamp", "time")
NUMERIC_DTYPES = ("int", "float", "double", "long", "decimal", "number")
ROW_ID_NAME = r"_id|id$|^id"
DEFAULT_LIMIT, ANOMALY_LIMIT, MAX_LIMIT = 5, 20, 100
DEFAULT_PERIODS, MAX_PERIODS = 3, 24

MAX_PROFILE_COLUMNS = 10_000


def _one_of(patterns: Iterable[str], whole_word: bool = False) -> str:
    """One alternation; word edges follow Unicode letters."""
    body = "|".join(patterns)
    return rf"(?U)\b(?:{body})\b" if whole_word else rf"(?U)(?:{body})"


def says(question: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs anywhere in the question."""
    return reduce(lambda a, b: a | b, [F.contains(question, F.lit(w)) for w in words])


def _mentions(question: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs as a whole word."""
    return question.rlike(_one_of(map(re.escape, words), whole_word=True))


def lowered(question: Column) -> Column:
    return F.lower(F.trim(question))


def label_intents(questions: DataFrame, question: str = "question", assistant_name: str | None = None) -> DataFrame:
    """``questions`` with ``intent, confidence, reason``; projections only, no shuffle.

    ``assistant_name`` makes "what is <name>" a general question.
    """
    q = F.col("_q")
    patterns = list(GREETING_PATTERNS)
    if assistant_name:
        patterns.append(rf"\bwhat is {re.escape(assistant_name.lower())}\b")
    # Staged, so that each pattern is matched once per question.
    staged = questions.withColumn("_q", lowered(F.col(question))).withColumns({
        "_greeting": q.rlike(_one_of(patterns)) & ~says(q, BUSINESS_WORDS),
        "_data": _mentions(q, DATA_KEYWORDS),
        "_docs": _mentions(q, DOCS_KEYWORDS),
    })
    hybrid = (F.col("_data") & F.col("_docs")) | q.rlike(_one_of(HYBRID_PATTERNS))
    case = (
        F.when(F.col("_greeting"), "greeting").when(hybrid, "HYBRID").when(F.col("_data"), "DATA")
        .when(F.col("_docs"), "DOCS").otherwise("unknown")
    )

    def by_case(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("_case")]

    intent = F.when(F.col("_case").isin("greeting", "unknown"), "GENERAL").otherwise(F.col("_case"))
    return staged.withColumn("_case", case).select(
        *questions.columns, intent.alias("intent"), by_case(CONFIDENCE).alias("confidence"), by_case(REASONS).alias("reason")
    )


def _count_in(question: Column, pattern: str, default: int, most: int) -> Column:
    digits = F.regexp_extract(question, f"(?U){pattern}", 1)
    # Digits beyond any INT are certainly above the maximum. (LEAST and GREATEST skip NULLs, so
    # the default must not pass through them.)
    number = F.when(F.length(digits) > 9, F.lit(most)).when(F.length(digits) > 0, digits.try_cast("int"))
    return F.when(number.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(1), F.least(number, F.lit(most))))


def parameter_columns(question: Column) -> tuple[Column, Column, Column]:
    """``(limit, periods, frequency)`` asked for in a lowered question."""
    q = question
    frequency = reduce(lambda case, pair: case.when(q.contains(pair[0]), pair[1]), FREQUENCY_WORDS[1:],
                       F.when(q.contains(FREQUENCY_WORDS[0][0]), FREQUENCY_WORDS[0][1]))
    return (
        _count_in(q, TOP_COUNT, DEFAULT_LIMIT, MAX_LIMIT),
        _count_in(q, NEXT_COUNT, DEFAULT_PERIODS, MAX_PERIODS),
        frequency,
    )


def label_parameters(questions: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with ``top_limit, periods, frequency``."""
    limit, periods, frequency = parameter_columns(F.col("_q"))
    staged = questions.withColumn("_q", lowered(F.col(question)))
    return staged.select(*questions.columns, limit.alias("top_limit"), periods.alias("periods"), frequency.alias("frequency"))


class Roles(NamedTuple):
    """Column names of one table by the role they can play, in column order."""

    metrics: list[str]
    dimensions: list[str]
    dates: list[str]


def column_role(name: Column, semantic_type: Column, dtype: Column) -> Column:
    """Role of a profiled column: ``date``, ``metric``, ``row_id`` or ``dimension``."""
    lower_name = F.lower(name)
    is_date = (semantic_type == "datetime") | says(lower_name, DATE_NAME_HINTS)
    is_number = (semantic_type == "numeric") | says(F.lower(dtype), NUMERIC_DTYPES)
    return (
        F.when(is_date, "date")
        .when(is_number, F.when(lower_name.rlike(ROW_ID_NAME), "row_id").otherwise("metric"))
        .otherwise("dimension")
    )


def column_roles(columns: DataFrame) -> DataFrame:
    """``(ordinal, name, role)`` of profiled columns."""
    role = column_role(F.col("name"), F.col("semantic_type"), F.col("dtype"))
    return columns.select("ordinal", "name", role.alias("role"))


def roles_of(columns: DataFrame) -> Roles:
    """The roles as lists; a profile has one row per column of its table, which is checked."""
    rows = column_roles(columns).orderBy("ordinal").take(MAX_PROFILE_COLUMNS + 1)
    if len(rows) > MAX_PROFILE_COLUMNS:
        raise AnalyticsError("TOO_MANY_COLUMNS", f"Profiles of up to {MAX_PROFILE_COLUMNS} columns are matched.")
    named = {role: [r["name"] for r in rows if r["role"] == role] for role in ("metric", "dimension", "date")}
    return Roles(named["metric"], named["dimension"], named["date"])


def _named(question: Column, name: str) -> Column:
    return question.rlike(rf"(?U)\b{re.escape(name.lower())}s?\b")


def _synonym(question: Column, name: str, synonyms) -> Column | None:
    for names, words in synonyms:
        if name.lower() in names:
            return says(question, words)
    return None


def _any(conditions: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a | b, [c for c in conditions if c is not None])


def _matches(pairs: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds, in order."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in pairs]))


def mention_columns(question: Column, roles: Roles) -> tuple[Column, Column, Column]:
    """``(metrics, dimensions, dates)``: the columns a lowered question mentions, in column order."""
    q = question
    metrics = [(c, _any([_named(q, c), _synonym(q, c, METRIC_SYNONYMS)])) for c in roles.metrics]

    def plural(name: str) -> Column | None:
        if not name.lower().endswith("y"):
            return None
        return q.rlike(rf"(?U)\b{re.escape(name.lower()[:-1])}ies\b")

    dimensions = [(c, _any([_named(q, c), plural(c), _synonym(q, c, DIMENSION_SYNONYMS)])) for c in roles.dimensions]
    dates = [(c, _any([_named(q, c), says(q, DATE_WORDS)])) for c in roles.dates]
    return _matches(metrics), _matches(dimensions), _matches(dates)


def match_columns(questions: DataFrame, columns: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with the arrays ``metrics, dimensions, dates`` of mentioned columns.

    The profile becomes constants of the projection, so the questions are neither joined nor moved.
    """
    metrics, dimensions, dates = mention_columns(F.col("_q"), roles_of(columns))
    staged = questions.withColumn("_q", lowered(F.col(question)))
    return staged.select(*questions.columns, metrics.alias("metrics"), dimensions.alias("dimensions"), dates.alias("dates"))


def asks_forecast(question: Column) -> Column:
    return says(question, FORECAST_WORDS) | question.rlike(f"(?U){NEXT_PERIODS}")


# What is said when a question cannot be answered.
NO_METRIC = {
    "anomaly": "Could not determine which numeric column to check for anomalies.",
    "forecast": "Could not determine which numeric column to forecast.",
    "trend": "Could not determine which numeric metric to calculate for the trend.",
}
NO_DATE = {
    "forecast": "The active dataset does not have a date or timestamp column to calculate time-series forecasts.",
    "trend": "The active dataset does not have a date or timestamp column to calculate time trends.",
}
NO_DIMENSION = "Could not determine which category or dimension to group by."
NO_TOP_METRIC = ("Could not determine which numeric metric to analyze for '", "'.")


def label_operations(questions: DataFrame, columns: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with the analysis each asks for and its arguments.

    Adds ``operation`` (anomaly, forecast, trend, top, kpis, ambiguous, error), ``ambiguous``,
    ``message``, ``metric_column, dimension_column, date_column, aggregation, row_limit, periods,
    frequency``. Anomaly wins over forecast, trend, ranking and KPIs. Columns are never guessed:
    without a mentioned metric only a table's single metric is used.
    """
    roles = roles_of(columns)
    q = F.col("_q")
    metrics, dimensions, dates = mention_columns(q, roles)
    asked_limit, asked_periods, asked_frequency = parameter_columns(q)

    wanted = (
        F.when(says(q, ANOMALY_WORDS), "anomaly")
        .when(asks_forecast(q), "forecast")
        .when(says(q, TREND_WORDS) & says(q, TREND_CONTEXT), "trend")
        .when(says(q, TOP_WORDS) | says(q, BREAKDOWN_WORDS) | q.rlike(f"(?U){BREAKDOWN_PATTERN}"), "top")
        .otherwise("kpis")
    )
    staged = questions.withColumn("_q", lowered(F.col(question))).withColumns({
        "_wanted": wanted, "_metric": F.get(metrics, F.lit(0)), "_dimension": F.get(dimensions, F.lit(0)),
        "_date": F.get(dates, F.lit(0)),
    })
    wanted = F.col("_wanted")
    only = F.lit(roles.metrics[0] if len(roles.metrics) == 1 else None).cast("string")
    metric = F.coalesce("_metric", only)
    first_date = F.lit(roles.dates[0] if roles.dates else None).cast("string")
    first_dimension = F.lit(roles.dimensions[0] if roles.dimensions else None).cast("string")
    date, dimension = F.coalesce("_date", first_date), F.coalesce("_dimension", first_dimension)

    no_date = wanted.isin(*NO_DATE) & F.lit(not roles.dates)
    no_dimension = (wanted == "top") & F.col("_dimension").isNull()
    no_metric = (wanted != "kpis") & metric.isNull()
    operation = F.when(no_date, "error").when(no_dimension | no_metric, "ambiguous").otherwise(wanted)

    def said(texts: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[wanted]

    top_message = F.concat(F.lit(NO_TOP_METRIC[0]), F.col("_dimension"), F.lit(NO_TOP_METRIC[1]))
    message = (
        F.when(no_date, said(NO_DATE))
        .when(no_dimension, NO_DIMENSION)
        .when(no_metric, F.when(wanted == "top", top_message).otherwise(said(NO_METRIC)))
    )
    settled = ~(no_date | no_dimension | no_metric)

    def per_operation(**values: Column) -> Column:
        case = None
        for name, value in values.items():
            case = F.when(settled & (wanted == name), value) if case is None else case.when(settled & (wanted == name), value)
        return case

    monthly = F.when(says(q, MONTHLY_WORDS), "month").otherwise("auto")
    return staged.select(
        *questions.columns,
        operation.alias("operation"),
        (~no_date & (no_dimension | no_metric)).alias("ambiguous"),
        message.alias("message"),
        F.when(settled, F.when(wanted == "kpis", F.col("_metric")).otherwise(metric)).alias("metric_column"),
        per_operation(anomaly=dimension, top=F.col("_dimension"), kpis=F.col("_dimension")).alias("dimension_column"),
        per_operation(anomaly=date, forecast=date, trend=date, kpis=F.col("_date")).alias("date_column"),
        F.when(settled, "sum").alias("aggregation"),
        per_operation(anomaly=F.lit(ANOMALY_LIMIT), trend=asked_limit, top=asked_limit, kpis=asked_limit).alias("row_limit"),
        per_operation(forecast=asked_periods).alias("periods"),
        per_operation(forecast=asked_frequency, trend=monthly).alias("frequency"),
    )
