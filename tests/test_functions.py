import random

import pytest
from pyspark.sql import functions as F

from sheafline.functions import dates, numbers, text, urls
from sheafline.functions.splitting import split_text


@pytest.fixture
def each(spark):
    """Apply an expression to single values."""
    def run(build, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
        return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]

    return run


def test_display_numbers(each):
    values = [28000.0, 1234.5, 0.0, -1234.567, 99.999, 0.001, None, float("inf"), 1e12, 12.10, -0.5]
    assert each(numbers.display_number, values, "double") == [
        "28,000", "1,234.5", "0", "-1,234.57", "100", "0", "N/A", "N/A", "1,000,000,000,000", "12.1", "-0.5"]
    assert each(numbers.display_number, [1234567], "long") == ["1,234,567"]


def test_plain_numbers(each):
    assert each(numbers.plain_number, [68.0, 29.17, 0.0, 12500.0, None], "double") == ["68.0", "29.17", "0.0", "12500.0", "None"]


def test_parse_numbers(each):
    values = ["5", " 5 ", "1d", "1,000", "1e3", ".5", "5.", "inf", "-Infinity", "nan", "", "0x1", None]
    assert each(numbers.parse_number, values) == [5.0, 5.0, None, None, 1000.0, 0.5, 5.0, float("inf"), float("-inf"), None, None, None, None]


def test_rounding_is_half_even(each):
    assert each(lambda v: numbers.half_even(v, 2), [0.125, 0.375, 29.1666], "double") == [0.12, 0.38, 29.17]


def test_share(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(numbers.share_percent(F.col("a"), F.col("b"))).collect()] == [33.33, 0.0]


def test_display_periods(each):
    values = ["2026-01", "2026-13", "2026-1", "2026-Q1", "2026-W05", "2026", "x", None]
    assert each(dates.display_period, values) == ["Jan 2026", "2026-13", "2026-1", "2026-Q1", "2026-W05", "2026", "x", None]


def test_clean_text(each):
    values = ["  \tline\x00 one\x07\n two\r\n ", "\u00a0\u3000x\u2028", "a\tb", "", None]
    assert each(text.clean_text, values) == ["line one\n two", "x", "a\tb", "", None]


def test_file_names(each):
    values = ["../../etc/pass wd.csv", "C:\\data\\q1 (final).csv", "", "a/", "ok-1_2.CSV"]
    assert each(text.safe_filename, values) == ["pass_wd.csv", "q1__final_.csv", "dataset", "dataset", "ok-1_2.CSV"]


def test_arguments(each):
    assert each(text.argument_text, [" Sum ", "  ", None]) == ["sum", None, None]


def test_merged_json(each):
    values = ['```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} and {"c": 3, "a": 4}.', "no json", "{broken", None, '{"a": "}{"}', '{"a": 1}{bad}']
    found = each(text.merged_json, values)
    assert found == ['{"a": 1}', '{"a": 4, "c": 3}', None, None, None, '{"a": "}{"}', None]


def test_links(each):
    sheet = "https://docs.google.com/spreadsheets/d/1z4-k_w/edit?usp=sharing"
    assert each(urls.sheet_export_url, [sheet, "https://x.org/a"]) == [
        "https://docs.google.com/spreadsheets/d/1z4-k_w/export?format=csv", "https://x.org/a"]
    links = [sheet, "https://raw.githubusercontent.com/a/b/c.csv", "http://x.org/A.CSV?q=1", "http://x.org/a.json#f", "ftp://x.org", "nothing", None]
    assert each(urls.link_kind, links) == ["sheet", "raw", "csv", "json", "other", None, None]
    repos = ["https://github.com/apache/spark.git", "https://github.com/apache/spark/issues", "https://x.org"]
    assert each(urls.repository_owner, repos) == ["apache", "apache", None]
    assert each(urls.repository_name, repos) == ["spark", "spark", None]


def test_answer_sections(spark):
    answer = ("⚡ **T:**\n\n### 📊 DATA FINDINGS\nfact a\nfact b\n\n### 📄 DOCUMENT EVIDENCE\n• x\n\n### ⚡ AI INTERPRETATION\nbecause\n\n"
              "### 🔗 CITATIONS\n**Sources:**\n- f.pdf (Page 1)")
    lone = "📊 **DATA FINDINGS**\n\n• **Statistical Anomaly Detection for x (IQR Method):**\n  - ok"
    df = spark.createDataFrame([(0, answer), (1, lone), (2, "plain"), (3, "📊 **DATA FINDINGS (FORECAST)**\nProjected Estimates")], "i int, t string")
    rows = df.select(*[c.alias(n) for n, c in text.answer_sections(F.col("t")).items()]).collect()
    assert (rows[0]["data_findings"], rows[0]["document_evidence"], rows[0]["interpretation"]) == ("fact a\nfact b", "• x", "because")
    assert rows[0]["citations"] == "**Sources:**\n- f.pdf (Page 1)"
    assert rows[1]["data_findings"].startswith("• **Statistical") and rows[1]["is_anomaly"] and not rows[1]["is_forecast"]
    assert rows[2]["data_findings"] == "" and not rows[2]["is_anomaly"]
    assert rows[3]["is_forecast"]


RNG = random.Random(2)


def letters(count):
    """Letters without repeats of any length that matters, so a chunk has one place in its text."""
    return "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzäéßñ") for _ in range(count))


TEXTS = [
    "", "   \n ", "short", " ".join(letters(RNG.randrange(5, 14)) for _ in range(300)), letters(2500),
    "\n\n".join(f"{letters(30)} {letters(9)}.\n{letters(25)}" for _ in range(60)),
    letters(90) + " " + letters(300) + "\n" + " ".join(letters(9) for _ in range(40)), (letters(8) + " \n ") + letters(400) + "\n\n\n",
]


@pytest.mark.parametrize("size, overlap", [(100, 20), (300, 50), (1000, 200), (10, 0), (7, 6)])
@pytest.mark.parametrize("content", TEXTS)
def test_chunks_keep_size_order_and_every_character(content, size, overlap):
    chunks = split_text(content, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    squeeze = lambda s: "".join(s.split())
    whole, covered = squeeze(content), 0
    for c in chunks:
        piece = squeeze(c)
        start = next((s for s in range(covered, max(-1, covered - len(piece) - 1), -1) if whole.startswith(piece, s)), -1)
        assert start != -1
        covered = max(covered, start + len(piece))
    assert covered == len(whole)


def test_chunks_overlap_by_whole_pieces():
    content = " ".join(f"w{i:03d}" for i in range(100))
    chunks = split_text(content, 50, 20)
    for before, after in zip(chunks, chunks[1:]):
        shared = [w for w in after.split() if w in before.split()]
        assert shared and shared == before.split()[-len(shared):] and len(" " + " ".join(shared)) <= 20


def test_words_stay_whole_without_the_character_separator():
    assert split_text("aa " + "x" * 50 + " bb", 10, 0, ("\n\n", "\n", " ")) == ["aa", " " + "x" * 50, "bb"]
