import datetime as dt

import pytest

from sheafline.errors import AnalyticsError
from sheafline.operators import columns, trend
from test_aggregate import SALES, SALES_SCHEMA

SERIES = "Date string, v double"


def labels(df):
    return {r["period"]: r["value"] for r in df.collect()}


def test_months_of_text_dates(frame):
    assert labels(trend.time_trend(frame(SALES, SALES_SCHEMA), "date", "revenue", frequency="monthly")) == {
        "2026-01": 3000.0, "2026-02": 2000.0, "2026-03": 5500.0, "2026-04": 2000.0}
    row = trend.trend_summary(frame(SALES, SALES_SCHEMA), "Date", "month").first()
    assert (row["frequency"], row["span_days"], row["number_of_periods"], row["min_date"]) == ("month", 110, 4, "2026-01-05T00:00:00")


@pytest.mark.parametrize("days, expected", [
    (31, "2024-02-01"), (32, "2024-W05"), (180, "2024-W26"), (181, "2024-06"), (730, "2025-12"), (731, "2026-Q1"),
    (1825, "2028-Q4"), (1826, "2028"),
])
def test_automatic_frequency_follows_the_span(frame, days, expected):
    start = dt.datetime(2024, 1, 1)
    df = frame([(start, 1.0), (start + dt.timedelta(days=days), 2.0)], "t timestamp_ntz, v double")
    assert expected in labels(trend.time_trend(df, "t", "v"))


def test_span_counts_whole_days(frame):
    df = frame([(dt.datetime(2024, 1, 1, 23), 1.0), (dt.datetime(2024, 1, 2, 1), 1.0)], "t timestamp_ntz, v double")
    assert trend.trend_summary(df, "t").first()["span_days"] == 0


def test_dates_are_read_month_first_where_every_value_can_be(frame):
    df = frame([("01/06/2026", 1.0), ("02/13/2026", 2.0), (None, 3.0)], "d string, v double")
    assert labels(trend.time_trend(df, "d", "v", frequency="day")) == {"2026-01-06": 1.0, "2026-02-13": 2.0}


def test_one_day_first_value_makes_the_column_day_first(frame):
    for rows in ([("01/06/2026", 1.0), ("13/06/2026", 2.0)], [("13/06/2026", 2.0), ("01/06/2026", 1.0)]):
        df = frame([*rows, ("04/25/2026", 4.0), (None, 3.0)], "d string, v double")
        assert labels(trend.time_trend(df, "d", "v", frequency="day")) == {"2026-06-01": 1.0, "2026-06-13": 2.0, "2026-04-25": 4.0}


def test_spellings_mix_in_one_column(frame):
    rows = [("03/04/2024", 1.0), ("25/04/2024", 2.0), ("2024-05-01", 4.0), (" 2024-05-02 10:30 ", 8.0), ("Jun 7, 2024", 16.0), ("never", 32.0)]
    df = frame(rows, "d string, v double")
    assert labels(trend.time_trend(df, "d", "v", frequency="month")) == {"2024-04": 3.0, "2024-05": 12.0, "2024-06": 16.0}
    assert tuple(columns.date_counts(df, "d").first()) == (6, 5, 1)


def test_missing_metric_sums_to_zero_and_infinity_stays_out_of_the_answer(frame):
    df = frame([("2024-01-01", None), ("2024-01-02", float("inf")), ("2024-01-03", 2.0)], SERIES)
    assert labels(trend.time_trend(df, "Date", "v", frequency="day")) == {"2024-01-01": 0.0, "2024-01-02": None, "2024-01-03": 2.0}
    assert labels(trend.time_trend(df, "Date", None, "count", "year")) == {"2024": 3.0}


def test_no_dates(frame):
    df = frame([(None, 1.0)], SERIES)
    with pytest.raises(Exception, match="NO_VALID_DATES"):
        trend.trend_summary(df, "Date").collect()
    with pytest.raises(AnalyticsError, match="NO_VALID_DATA"):
        trend.forecast_metric(df, "v", "Date")


def test_week_labels_across_new_year(frame):
    df = frame([("2024-12-29", 1.0), ("2024-12-30", 10.0), ("2025-01-05", 100.0), ("2024-01-01", 1000.0)], SERIES)
    assert labels(trend.time_trend(df, "Date", "v", frequency="week")) == {"2024-W52": 1.0, "2024-W01": 1010.0, "2025-W01": 100.0}
    assert labels(trend.time_trend(df, "Date", "v", frequency="week", week_year="iso")) == {
        "2024-W52": 1.0, "2025-W01": 110.0, "2024-W01": 1000.0}
    rows = trend.forecast_metric(df, "v", "Date", 1, "weekly").collect()
    past = sorted((r["step"], r["period"]) for r in rows if r["kind"] == "historical")
    assert past == [(0, "2024-W01"), (1, "2024-W52"), (2, "2024-W01"), (3, "2025-W01")]
    before = trend.forecast_metric(df.filter("Date < '2024-12-30'").union(frame([("2024-12-20", 1.0), ("2024-12-23", 1.0)], SERIES)),
                                   "v", "Date", 1, "week").filter("kind = 'projected'").first()
    assert before["period"] == "2025-W01"


def monthly(*values, start=1, year=2023):
    return [(f"{year}-{start + i:02d}-10", float(v)) for i, v in enumerate(values)]


def projected(df):
    return [(r["period"], r["value"]) for r in df.filter("kind = 'projected'").orderBy("step").collect()]


def test_line_through_a_growing_series(frame):
    df = trend.forecast_metric(frame(monthly(100, 110, 120, 130, 140), SERIES), "v", "date", 3, "monthly")
    assert projected(df) == [("2023-06", 150.0), ("2023-07", 160.0), ("2023-08", 170.0)]
    row = df.first()
    assert (row["slope"], row["direction"], row["frequency"], row["historical_count"], row["status"]) == (10.0, "up", "month", 5, "ok")


@pytest.mark.parametrize("values, direction", [((10, 25, 40, 60), "up"), ((100, 80, 60, 40), "down"), ((50, 50, 50, 50), "flat")])
def test_directions(frame, values, direction):
    df = trend.forecast_metric(frame(monthly(*values), SERIES), "v", "Date", 1, "month")
    assert df.first()["direction"] == direction
    if direction == "flat":
        assert projected(df)[0][1] == 50.0 and df.first()["slope"] == 0.0


def test_labels_roll_over_and_gaps_do_not_stretch_the_line(frame):
    assert [p for p, _ in projected(trend.forecast_metric(frame(monthly(1, 2, 3, start=10), SERIES), "v", "Date", 3, "month"))] == [
        "2024-01", "2024-02", "2024-03"]
    gap = frame([("2023-01-10", 1.0), ("2023-02-10", 2.0), ("2023-09-10", 3.0)], SERIES)
    assert projected(trend.forecast_metric(gap, "v", "Date", 1, "month")) == [("2023-10", 4.0)]


@pytest.mark.parametrize("dates, frequency, expected", [
    (["2023-05-01", "2023-05-02", "2023-05-03", "2023-05-04"], "daily", "2023-05-05"),
    (["2023-01-02", "2023-01-09", "2023-01-16", "2023-01-23"], "weekly", "2023-W05"),
    (["2023-01-15", "2023-04-15", "2023-07-15", "2023-10-15"], "quarterly", "2024-Q1"),
    (["2021-06-01", "2022-06-01", "2023-06-01"], "yearly", "2024"),
])
def test_next_label(frame, dates, frequency, expected):
    df = trend.forecast_metric(frame([(d, float(i)) for i, d in enumerate(dates)], SERIES), "v", "Date", 1, frequency)
    assert projected(df)[0][0] == expected


def test_rows_of_a_period_add_up(frame):
    df = frame([("2023-01-01", 50.0), ("2023-01-20", 50.0), ("2023-02-01", 120.0), ("2023-03-01", 140.0)], SERIES)
    past = trend.forecast_metric(df, "v", "Date", 1, "month").filter("kind = 'historical'").orderBy("step").collect()
    assert [r["value"] for r in past] == [100.0, 120.0, 140.0]


def test_forecast_refusals(frame):
    two = frame(monthly(1, 2), SERIES)
    cases = [
        (lambda: trend.forecast_metric(two, "v", "Date", frequency="month"), "INSUFFICIENT_DATA"),
        (lambda: trend.forecast_metric(two, "v", "Date", 0), "INVALID_PERIODS"),
        (lambda: trend.forecast_metric(two, "v", "Date", 25), "INVALID_PERIODS"),
        (lambda: trend.forecast_metric(two, "v", "Date", 3, "hourly"), "INVALID_FREQUENCY"),
        (lambda: trend.forecast_metric(two.limit(0), "v", "Date"), "EMPTY_DATASET"),
        (lambda: trend.forecast_metric(frame([("2023-01-01", 1.0), ("2023-02-01", float("inf")), (None, 3.0),
                                              ("2023-03-01", float("nan")), ("2023-04-01", 2.0)], SERIES), "v", "Date", 3, "month"),
         "INSUFFICIENT_DATA"),
    ]
    for call, code in cases:
        with pytest.raises(AnalyticsError) as error:
            call()
        assert error.value.code == code


def test_one_model_per_group(frame):
    rows = [("up", d, v) for d, v in monthly(1, 2, 3)] + [("down", d, v) for d, v in monthly(9, 6, 3)] + [("short", d, v) for d, v in monthly(1, 2)]
    df = trend.forecast_metric(frame(rows, "k string, " + SERIES), "v", "Date", 2, "month", by=["K"])
    found = {(r["k"], r["period"]): (r["value"], r["status"]) for r in df.filter("kind = 'projected'").collect()}
    assert found == {("up", "2023-04"): (4.0, "ok"), ("up", "2023-05"): (5.0, "ok"),
                     ("down", "2023-04"): (0.0, "ok"), ("down", "2023-05"): (-3.0, "ok")}
    short = df.filter("k = 'short'").collect()
    assert len(short) == 2 and all(r["status"] == "INSUFFICIENT_DATA" and r["slope"] is None for r in short)


def test_chart_lines_meet_at_the_last_past_point(frame):
    chart = trend.forecast_chart(trend.forecast_metric(frame(monthly(1, 2, 3), SERIES), "v", "Date", 2, "month"))
    rows = [(r["period"], r["historical"], r["forecast"], r["type"]) for r in chart.orderBy("step").collect()]
    assert rows == [("2023-01", 1.0, None, "Historical"), ("2023-02", 2.0, None, "Historical"), ("2023-03", 3.0, 3.0, "Historical"),
                    ("2023-04", None, 4.0, "Projected"), ("2023-05", None, 5.0, "Projected")]


def test_residuals_of_the_line_cancel_out(frame):
    numbers = [3.0, 9.0, 4.0, 12.0, 1.0, 7.0]
    df = trend.forecast_metric(frame(monthly(*numbers), SERIES), "v", "Date", 1, "month")
    slope, after = df.first()["slope"], projected(df)[0][1]
    line = [after - slope * (6 - i) for i in range(6)]
    assert sum(v - y for v, y in zip(numbers, line)) == pytest.approx(0, abs=1e-2)


def test_periods_come_in_order(frame):
    rows = [(f"2024-{m:02d}-{d:02d}", k, 1.0) for m in (7, 2, 11) for d in (3, 1) for k in ("b", "a")]
    df = frame(rows, "d string, k string, v double").repartition(4)
    got = [(r["k"], r["period"]) for r in trend.time_trend(df, "d", "v", frequency="month", by=["k"]).collect()]
    assert got == sorted(got) and len(got) == 6
    steps = [(r["k"], r["step"]) for r in trend.forecast_metric(df, "v", "d", by=["k"]).collect()]
    assert steps == sorted(steps)
