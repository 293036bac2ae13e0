"""Facts for tables of questions: every distinct plan is run once, however many questions share it.

A question's labels say what to run on the table it is about. Plans of one shape share a scan: all rankings come from one aggregate
over grouping sets, all trends and projections from sums per day, all outliers from one pass over the metrics. What the driver
sees of the plans are pairs of columns, which the table's schema bounds; limits, periods and frequencies stay rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.dates import FREQUENCY_ALIASES, display_period, frequency_for_span, period_label, period_start, whole_days
from sheafline.functions.numbers import display_number, finite_or_null, half_even, is_finite, plain_number, share_percent
from sheafline.operators import facts
from sheafline.operators.aggregate import MAX_RANKED, aggregate_value, category_text, kpi_candidates, kpis
from sheafline.operators.anomalies import FENCE_QUANTILES, ROUNDED, fences
from sheafline.operators.cleanup import with_row_index
from sheafline.operators.columns import column, datetime_column, dtype_of, numeric_column, resolve_column
from sheafline.operators.quality import table_quality
from sheafline.operators.quantiles import exact_quantiles
from sheafline.operators.questions import (
    ANOMALY_LIMIT,
    ANOMALY_TOOL_WORDS,
    DEFAULT_PERIODS,
    KPI_WORDS,
    QUALITY_WORDS,
    asks_forecast,
    label_intents,
    label_operations,
    lowered,
    says,
)
from sheafline.operators.trend import project
from sheafline.session import written

PLAN_FIELDS = ("run", "metric", "dimension", "date", "row_limit", "periods", "frequency", "shown")
# Facts of all plans together are broadcast up to this many bytes; beyond it they are joined in SALTS parts.
BROADCAST_BYTES = 64 << 20
SALTS = 32


def _planned(questions: DataFrame, columns: DataFrame, metrics: Iterable[str], question: str) -> DataFrame:
    """``_row`` (the whole question row), ``intent, message, _plan, _key``."""
    rows = questions.select(F.struct(*[column(c) for c in questions.columns]).alias("_row"), column(question).alias("_question"))
    labelled = label_operations(label_intents(rows, "_question"), columns, "_question")
    q = F.col("_q")
    is_data = F.col("intent") == "DATA"
    tool = (
        F.when(~F.col("intent").isin("DATA", "HYBRID"), None)
        .when(is_data & says(q, KPI_WORDS), "kpis")
        .when(is_data & says(q, QUALITY_WORDS), "quality")
        .when(is_data & says(q, ANOMALY_TOOL_WORDS), "anomalies")
        .when(is_data & asks_forecast(q), "forecast")
        .otherwise("analysis")
    )
    has_metric, has_date = F.col("metric_column").isNotNull(), F.col("date_column").isNotNull()
    run = (
        F.when(F.col("_tool").isin("kpis", "quality"), F.col("_tool"))
        .when(F.col("_tool") == "anomalies", F.when(has_metric, "anomalies"))
        .when(F.col("_tool") == "forecast", F.when(has_metric & has_date, "forecast"))
        .when(F.col("_tool") == "analysis", F.when(F.col("operation").isin("top", "trend"), F.col("operation"))
              .when(~F.col("ambiguous"), "overview"))
    )
    named = [F.when(F.contains(F.lower("_question"), F.lit(m.lower())) | (F.col("metric_column") == m), F.lit(m)) for m in metrics]
    shown = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")

    def only(value: Column, *runs: str) -> Column:
        return F.when(F.col("_run").isin(*runs), value)

    full_names = F.create_map(*[F.lit(x) for pair in FREQUENCY_ALIASES.items() for x in pair])
    frequency = F.coalesce(full_names[F.col("frequency")], F.col("frequency"), F.lit("auto"))
    plan = F.when(F.col("_run").isNotNull(), F.struct(
        F.col("_run").alias("run"),
        only(F.col("metric_column"), "top", "trend", "forecast", "anomalies").alias("metric"),
        only(F.col("dimension_column"), "top", "anomalies").alias("dimension"),
        only(F.col("date_column"), "trend", "forecast", "anomalies").alias("date"),
        only(F.col("row_limit"), "top").alias("row_limit"),
        only(F.coalesce("periods", F.lit(DEFAULT_PERIODS)), "forecast").alias("periods"),
        only(frequency, "trend", "forecast").alias("frequency"),
        only(shown, "overview").alias("shown"),
    ))
    staged = labelled.withColumn("_q", lowered(F.col("_question"))).withColumn("_tool", tool).withColumn("_run", run).withColumn("_plan", plan)
    return staged.select("_row", "intent", "message", "_plan", F.to_json("_plan").alias("_key"))


def plan_questions(questions: DataFrame, columns: DataFrame, metrics: Iterable[str], question: str = "question") -> DataFrame:
    """``questions`` with ``intent, message, plan, plan_key``; projections only.

    ``columns`` is the profile of the table the questions are about and ``metrics`` its numeric-like columns. ``plan`` is a struct of
    ``PLAN_FIELDS``; its ``run`` is kpis, quality, anomalies, forecast, top, trend or overview, and NULL where nothing is to be run:
    for general questions, questions about documents, and questions whose columns cannot be told (``message`` says which).
    Equal plans have equal keys.
    """
    return _planned(questions, columns, metrics, question).select(
        "_row.*", "intent", "message", F.col("_plan").alias("plan"), F.col("_key").alias("plan_key"))


def _names(values: Iterable[str | None]) -> list[str]:
    return sorted({v for v in values if v is not None})


def _spelled(plan_key: Column, *told: tuple[Column | int, Column]) -> Column:
    """Rows of facts as an array of ``struct<plan_key, ord, fact>``."""
    return F.array(*[F.struct(plan_key.alias("plan_key"), (F.lit(o) if isinstance(o, int) else o).cast("long").alias("ord"), f.alias("fact"))
                     for o, f in told])


def _rankings(plans: DataFrame, df: DataFrame) -> DataFrame:
    """All rankings from one aggregate: a grouping set per dimension, a sum per metric, numbered once per pair."""
    pairs = [tuple(r) for r in plans.select("dimension", "metric").distinct().collect()]  # pairs of the table's columns
    dimensions, metrics = _names(d for d, _ in pairs), _names(m for _, m in pairs)
    keys = {d: f"_d{i}" for i, d in enumerate(dimensions)}
    sums = {m: f"_m{i}" for i, m in enumerate(metrics)}
    kinds = {d: dtype_of(df, resolve_column(df, d)) for d in dimensions}
    narrow = df.select(*[column(resolve_column(df, d)).alias(k) for d, k in keys.items()], *[numeric_column(df, m)[1].alias(s) for m, s in sums.items()])
    grouped = narrow.groupingSets([[F.col(k)] for k in keys.values()], *[F.col(k) for k in keys.values()]).agg(
        F.grouping_id().alias("_set"), *[aggregate_value(F.col(s), "sum").alias(s) for s in sums.values()])
    # In a grouping id the bits of the columns that are not in the set are 1, the last column's bit comes first.
    every = (1 << len(keys)) - 1
    place = {d: every - (1 << (len(keys) - 1 - i)) for i, d in enumerate(dimensions)}
    cells = [F.when(F.col("_set") == place[d], F.struct(
        F.lit(d).alias("dimension"), F.lit(m).alias("metric"), category_text(F.col(keys[d]), kinds[d]).alias("category"),
        finite_or_null(F.col(sums[m])).alias("value"))) for d, m in pairs]
    values = grouped.select(*keys.values(), F.explode(F.array_compact(F.array(*cells))).alias("_cell")).select("_cell.*", *keys.values())
    order = Window.partitionBy("dimension", "metric").orderBy(F.desc_nulls_last("value"), *[F.asc_nulls_last(k) for k in keys.values()])
    best = values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_RANKED).drop(*keys.values())
    found = plans.join(F.broadcast(best), ["dimension", "metric"]).where(F.col("rank") <= F.col("row_limit"))
    value = display_number(F.col("value"))
    winner = facts.sentence(facts.WINNER, F.col("category"), F.lower("metric"), value)
    each = facts.sentence(facts.CATEGORY, F.col("dimension"), F.col("category"), F.col("metric"), value)
    key, rank = F.col("plan_key"), F.col("rank")
    return found.select(F.inline(F.when(rank == 1, _spelled(key, (0, winner), (1, each))).otherwise(_spelled(key, (rank, each)))))


def _daily(plans: DataFrame, df: DataFrame) -> DataFrame:
    """``(date, metric, day, total, finite_total, finite, first, last, finite_first, finite_last)``: one aggregate over grouping sets
    of days gives the sums of every metric by every date column; as many rows as the calendar has days."""
    pairs = [tuple(r) for r in plans.select("date", "metric").distinct().collect()]  # pairs of the table's columns
    dates, metrics = _names(d for d, _ in pairs), _names(m for _, m in pairs)
    when = {d: datetime_column(df, d)[1].cast("timestamp") for d in dates}
    number = {m: numeric_column(df, m)[1] for m in metrics}
    stamps, values = {d: f"_t{i}" for i, d in enumerate(dates)}, {m: f"_m{i}" for i, m in enumerate(metrics)}
    days = {d: f"_d{i}" for i, d in enumerate(dates)}
    narrow = df.select(*[when[d].alias(s) for d, s in stamps.items()], *[F.to_date(when[d]).alias(k) for d, k in days.items()],
                       *[number[m].alias(v) for m, v in values.items()])
    sums = []
    for d, m in pairs:
        t, v = F.col(stamps[d]), F.col(values[m])
        usable = is_finite(v)
        sums.append(F.struct(
            aggregate_value(v, "sum").alias("total"), F.sum(F.when(usable, v)).alias("finite_total"), F.count_if(usable).alias("finite"),
            F.min(t).alias("first"), F.max(t).alias("last"), F.min(F.when(usable, t)).alias("finite_first"),
            F.max(F.when(usable, t)).alias("finite_last")).alias(f"_s{len(sums)}"))
    grouped = narrow.groupingSets([[F.col(k)] for k in days.values()], *[F.col(k) for k in days.values()]).agg(
        F.grouping_id().alias("_set"), *sums)
    every = (1 << len(days)) - 1
    cells = []
    for i, (d, m) in enumerate(pairs):
        mine = (F.col("_set") == every - (1 << (len(days) - 1 - dates.index(d)))) & F.col(days[d]).isNotNull()
        cells.append(F.when(mine, F.struct(
            F.lit(d).alias("date"), F.lit(m).alias("metric"), F.col(days[d]).alias("day"), F.col(f"_s{i}").alias("s"))))
    cell = grouped.select(F.explode(F.array_compact(F.array(*cells))).alias("_cell"))
    return cell.select("_cell.date", "_cell.metric", "_cell.day", "_cell.s.*")


def _over_time(plans: DataFrame, df: DataFrame) -> DataFrame:
    """Trends and projections, both from the sums per day."""
    daily = written(_daily(plans, df), "daily")
    spans = daily.groupBy("date", "metric").agg(
        frequency_for_span(whole_days(F.min("first"), F.max("last"))).alias("_auto"),
        frequency_for_span(whole_days(F.min("finite_first"), F.max("finite_last"))).alias("_finite_auto"))
    asked = plans.join(daily, ["date", "metric"]).join(spans, ["date", "metric"])

    auto = F.when(F.col("run") == "trend", F.col("_auto")).otherwise(F.col("_finite_auto"))
    dated = asked.withColumn("frequency", F.when(F.col("frequency") == "auto", auto).otherwise(F.col("frequency")))
    key, metric, period = F.col("plan_key"), F.col("metric"), F.col("period")

    sums = dated.where(F.col("run") == "trend").groupBy("plan_key", "metric", period_label(F.col("day"), F.col("frequency")).alias("period")).agg(
        finite_or_null(F.sum("total")).alias("value"))
    # Windows over periods of one plan only: the calendar bounds them.
    place = F.row_number().over(Window.partitionBy("plan_key").orderBy("period")) - 1
    line = facts.sentence(facts.PERIOD, display_period(period), period, metric, display_number(F.col("value")))
    trends = sums.withColumn("_place", place).select(F.inline(_spelled(key, (F.col("_place"), line))))

    past = dated.where((F.col("run") == "forecast") & (F.col("finite") > 0)).groupBy(
        "plan_key", "metric", "periods", "frequency", period_label(F.col("day"), F.col("frequency")).alias("period"),
        period_start(F.col("day"), F.col("frequency")).alias("period_start")).agg(F.sum("finite_total").alias("value"))
    lines = project(past, ["plan_key", "metric", "periods"], F.col("periods")).where(F.col("kind") == "projected")
    ahead = F.col("step") - F.col("historical_count")
    basis = facts.sentence(facts.FORECAST_BASIS, metric, F.col("periods"), F.col("frequency"), F.col("historical_count"))
    slope = facts.sentence(facts.FORECAST_SLOPE, facts.direction_word(F.col("direction")), display_number(F.col("slope")), F.col("frequency"))
    projected = facts.sentence(facts.PROJECTED, metric, display_period(period), display_number(F.col("value")))
    forecasts = lines.select(F.inline(F.when(ahead == 0, _spelled(key, (0, basis), (1, slope), (2, projected))).otherwise(
        _spelled(key, (ahead + 2, projected)))))
    return trends.unionByName(forecasts)


def _outliers(plans: DataFrame, df: DataFrame, key: str | None) -> DataFrame:
    """All outlier plans: quartiles of all metrics, then one pass that keeps the farthest of each metric and one that counts."""
    rows = [tuple(r) for r in plans.select("metric", "date", "dimension").distinct().collect()]  # columns of the table
    metrics = _names(m for m, _, _ in rows)
    if key is None:
        df, key = with_row_index(df, "_row"), "_row"
    number = {m: numeric_column(df, m)[1] for m in metrics}
    finite = {m: F.when(is_finite(v), v) for m, v in number.items()}
    found = fences(exact_quantiles(df, finite, FENCE_QUANTILES), ["metric"])
    bounds = {r["metric"]: r for r in found.collect()}  # a row per metric

    texts = _names([d for _, d, _ in rows] + [c for _, _, c in rows])
    shown = F.create_map(*[x for c in texts for x in (F.lit(c), column(resolve_column(df, c)).cast("string"))]) if texts else F.create_map().cast("map<string,string>")
    index = column(resolve_column(df, key))
    cells, counts = [], []
    for m in metrics:
        low, high = (bounds[m]["lower_bound"], bounds[m]["upper_bound"]) if m in bounds else (0.0, 0.0)
        v = finite[m]
        outside = (v < low) | (v > high)
        counts.append(F.struct(F.lit(m).alias("metric"), F.count(v).alias("valid"), F.count_if(outside).alias("outside"), *[
            F.lit(bounds[m][c] if m in bounds else 0.0).cast("double").alias(c) for c in ROUNDED]))
        cells.append(F.when(outside, F.struct(
            F.lit(m).alias("metric"), v.alias("value"), F.when(v > high, "high").otherwise("low").alias("direction"),
            F.when(v > high, v - high).otherwise(low - v).alias("deviation"))))
    seen = df.select(index.alias("_index"), shown.alias("_shown"), F.array_compact(F.array(*cells)).alias("_cells")).where(F.size("_cells") > 0)
    far = seen.select("_index", "_shown", F.explode("_cells").alias("_cell")).select("_index", "_shown", "_cell.*")
    order = Window.partitionBy("metric").orderBy(F.desc("deviation"), "_index")
    listed = far.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= ANOMALY_LIMIT)
    summary = df.agg(F.array(*counts).alias("_all")).select(F.inline("_all"))

    plan_key, metric = F.col("plan_key"), F.col("metric")
    figures = {c: display_number(half_even(F.col(c), 4)) for c in ROUNDED}
    lead = plans.join(F.broadcast(summary), "metric").select(F.inline(_spelled(
        plan_key,
        (0, facts.sentence(facts.ANOMALY_COUNT, F.col("outside"), metric, plain_number(share_percent(F.col("outside"), F.col("valid"))), F.col("valid"))),
        (1, facts.sentence(facts.ANOMALY_BOUNDS, metric, *[figures[c] for c in ("lower_bound", "upper_bound", "q1", "q3", "iqr")])),
    )))
    # At most ANOMALY_LIMIT rows per metric.
    setting = facts.outlier_setting(F.try_element_at("_shown", F.col("date")), F.try_element_at("_shown", F.col("dimension")))
    line = facts.sentence(facts.ANOMALY_ROW, F.col("_index"), facts.outlier_word(F.col("direction")), metric, display_number(F.col("value")), setting)
    each = plans.join(F.broadcast(listed), "metric").select(F.inline(_spelled(plan_key, (F.col("_place") + 1, line))))
    return lead.unionByName(each)


def _same_for_all(plans: DataFrame, told: DataFrame) -> DataFrame:
    """A small table of facts for each of the plans."""
    held = told.agg(F.array_sort(F.collect_list(F.struct("ord", "fact")))).scalar()
    return plans.select("plan_key", F.inline(held))


def _overviews(plans: DataFrame, size: DataFrame, figures: DataFrame) -> DataFrame:
    """Size and quality, then the KPIs a question names, or else the first four."""
    line = F.struct("ordinal", "metric", facts.metric_sentence().alias("fact"))
    every = figures.where(~F.col("excluded")).agg(F.array_sort(F.collect_list(line))).scalar()
    lead = size.agg(F.array_sort(F.collect_list(F.struct("ord", "fact")))).scalar()
    staged = plans.select("plan_key", "shown", every.alias("_every"), lead.alias("_lead"))
    named = F.filter("_every", lambda f: F.array_contains("shown", f["metric"]))
    chosen = F.when(F.size(named) > 0, named).otherwise(F.slice("_every", 1, facts.DEFAULT_KPIS))
    more = F.transform(chosen, lambda f: F.struct((f["ordinal"] + 2).cast("long").alias("ord"), f["fact"].alias("fact")))
    return staged.select("plan_key", F.inline(F.concat("_lead", more)))


def run_plans(plans: DataFrame, df: DataFrame, filename: str, key: str | None = None) -> DataFrame:
    """``(plan_key, ord, fact)`` of distinct plans; jobs grow with the shapes of the plans, not with their number.

    ``plans`` has ``plan_key`` and the plan's fields. A plan without a result (a forecast over fewer than three periods, a ranking of
    nothing) has no facts. ``key`` names the column that identifies rows in sentences about outliers; without one rows are numbered.
    """
    shapes = {r["run"] for r in plans.select("run").distinct().collect()}  # the seven runs at most
    of = lambda *runs: plans.where(F.col("run").isin(*runs))
    parts = []
    if "top" in shapes:
        parts.append(_rankings(of("top"), df))
    if shapes & {"trend", "forecast"}:
        parts.append(_over_time(of("trend", "forecast"), df))
    if "anomalies" in shapes:
        parts.append(_outliers(of("anomalies"), df, key))
    if shapes & {"kpis", "overview"}:
        figures = written(kpis(df), "kpis")
    if shapes & {"quality", "overview"}:
        quality = written(table_quality(df), "quality")
    if "kpis" in shapes:
        parts.append(_same_for_all(of("kpis"), facts.kpi_facts(figures)))
    if "quality" in shapes:
        parts.append(_same_for_all(of("quality"), facts.quality_facts(quality, filename)))
    if "overview" in shapes:
        parts.append(_overviews(of("overview"), facts.size_facts(quality, filename), figures))
    if not parts:
        return plans.select("plan_key", F.lit(0).cast("long").alias("ord"), F.lit("").alias("fact")).where("false")
    return reduce(DataFrame.unionByName, parts)


def question_facts(
    questions: DataFrame, df: DataFrame, columns: DataFrame, filename: str = "Dataset", question: str = "question", key: str | None = None
) -> DataFrame:
    """``questions`` with ``intent, message, run, data_facts``: the facts of the table ``df`` that each question asks for.

    ``columns`` is the profile of ``df`` (``ordinal, name, semantic_type, dtype``). Questions without a plan, or whose plan has no
    result, have an empty array. A question asked by a third of all rows costs one plan; facts come back by a broadcast of checked
    size, or beyond it by a join in which each plan stands ``SALTS`` times.
    """
    planned = _planned(questions, columns, kpi_candidates(df), question)
    # Filtered after it is written: a filter on the key would carry all labels' expressions along, once per use.
    plans = written(planned.select(F.col("_key").alias("plan_key"), "_plan").distinct(), "plans")
    plans = plans.where(F.col("plan_key").isNotNull()).select("plan_key", "_plan.*")
    in_order = F.array_sort(F.collect_list(F.struct("ord", "fact")))
    told = run_plans(plans, df, filename, key).groupBy("plan_key").agg(F.transform(in_order, lambda f: f["fact"]).alias("_facts"))
    told = written(told, "facts")
    length = F.aggregate("_facts", F.lit(0).cast("long"), lambda n, f: n + F.octet_length(f) + 16)
    size = told.agg(F.sum(length + F.octet_length("plan_key"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = planned.join(F.broadcast(told), F.col("_key") == F.col("plan_key"), "left")
    else:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
        copies = told.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        salted = planned.withColumn("_part", salt)
        joined = salted.join(copies, (F.col("_key") == F.col("plan_key")) & (F.col("_part") == F.col("_salt")), "left")
    return joined.select("_row.*", "intent", "message", F.col("_plan.run").alias("run"),
                         F.coalesce("_facts", F.array().cast("array<string>")).alias("data_facts"))
