import json

import pytest
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.operators import charts, cleanup
from sheafline.plans import profile as profiles
from sheafline.sources import documents, feeds, registry, tables
from sheafline.sources.tables import normalize_headers


@pytest.fixture
def write(tmp_path):
    def save(content, name="t.csv", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
        return str(path)

    return save


@pytest.mark.parametrize("headers, expected", [
    ([" a ", "a", "A", "a"], ["a", "a_1", "A", "a_2"]),
    (["", "Unnamed: 1", None, "x"], ["column_1", "column_2", "column_3", "x"]),
    (["a_1", "a", "a"], ["a_1", "a", "a_2"]),
    (["a", "a_1", "a"], ["a", "a_1", "a_2"]),
    (["column_2", ""], ["column_2", "column_2_1"]),
])
def test_headers(headers, expected):
    assert normalize_headers(headers) == expected
    assert len(set(normalize_headers(headers))) == len(headers)


def test_csv_types_and_missing_tokens(spark, write):
    path = write('id,price,ok,name,mixed,gone\n1,1.5,True,"Smith, J",1,NA\n2,NaN,false,"say ""hi""",x,null\n3,-2e3,,n/a,3,\n')
    df = tables.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "price": "double", "ok": "boolean", "name": "string", "mixed": "string", "gone": "string"}
    rows = df.orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1.5, True, "Smith, J", "1", None), (2, None, False, 'say "hi"', "x", None), (3, -2000.0, None, None, "3", None)]


def test_csv_headers_blank_repeated_and_quoted(spark, write):
    df = tables.read_csv(spark, write('a,,a,"b,c"\n1,2,3,4\n'))
    assert df.columns == ["a", "column_2", "a_1", "b,c"]
    assert tuple(df.first()) == (1, 2, 3, 4)


def test_csv_in_latin1(spark, write):
    df = tables.read_csv(spark, write("name,n\ncafé,1\nüber,2\n", encoding="latin-1"))
    assert sorted(r["name"] for r in df.collect()) == ["café", "über"]


def test_csv_with_a_title_line_above_the_header(spark, write):
    df = tables.read_csv(spark, write("Unnamed: 0,Unnamed: 1\nCity,People\nRome,3\nOslo,1\n"))
    assert df.columns == ["City", "People"]
    assert sorted(tuple(r) for r in df.collect()) == [("Oslo", 1), ("Rome", 3)]


def test_csv_of_nothing_and_of_a_header_only(spark, write):
    with pytest.raises(AnalyticsError, match="EMPTY_DATASET"):
        tables.read_csv(spark, write("", "empty.csv"))
    header = tables.read_csv(spark, write("a,b\n", "header.csv"))
    assert header.columns == ["a", "b"] and header.count() == 0


def test_csv_semicolons_and_several_files(spark, write, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "1.csv").write_text("a;b\n1;x\n")
    (folder / "2.csv").write_text("a;b\n2;y\n")
    df = tables.read_csv(spark, str(folder), delimiter=";")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y")]


def test_csv_round_trip(spark, frame, tmp_path):
    df = frame([(1, 'a "quoted", text', 1.5), (2, None, None)], "id long, t string, v double")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(df.collect())


def test_json_is_flattened(spark, write):
    path = write(json.dumps([{"a": 1, "b": {"c": 2, "d": {"e": [1, 2]}}}, {"a": 2, "b": None}]), "t.json")
    df = tables.read_json(spark, path)
    assert df.columns == ["a", "b.c", "b.d.e"]
    assert sorted((r[0], r[1], r[2]) for r in df.collect()) == [(1, 2, [1, 2]), (2, None, None)]


def test_values_fit_for_json(spark):
    df = spark.sql("""SELECT double('nan') AS a, double('inf') AS b, timestamp_ntz'2024-01-02 03:04:05' AS c, date'2024-01-02' AS d,
                      1.5BD AS e, array(double('nan'), 1D) AS f, map('k', double('inf')) AS g, named_struct('x', double('nan')) AS h""")
    row = cleanup.json_safe(df).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (None, None, "2024-01-02T03:04:05", "2024-01-02T00:00:00", "1.5")
    assert row["f"] == [None, 1.0] and row["g"] == {"k": None} and row["h"]["x"] is None


def test_preview(spark):
    df = spark.range(25).coalesce(1)
    rows = cleanup.preview(df, 10).collect()
    assert [r["id"] for r in rows] == list(range(10)) and rows[0]["total_rows"] == 25 and rows[0]["total_columns"] == 1
    assert cleanup.preview(spark.range(500), 400).count() == 100
    with pytest.raises(AnalyticsError, match="INVALID_LIMIT"):
        cleanup.preview(df, -1)


def test_empty_rows_and_columns_are_dropped(frame):
    df = frame([(1.0, None, None), (float("nan"), None, None), (None, "x", None)], "a double, b string, c string")
    kept = cleanup.drop_empty_rows(cleanup.drop_empty_columns(df))
    assert kept.columns == ["a", "b"] and kept.count() == 2


def test_charts(frame):
    df = frame([("a",), ("b",), ("b",), (None,), ("c",)], "x string")
    assert [tuple(r) for r in charts.value_counts_chart(df, "X").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert [tuple(r) for r in charts.line_chart(df, "x").collect()] == [("a", 1), ("b", 2), ("c", 1), (None, 1)]
    assert charts.value_counts_chart(frame([(f"v{i:02d}",) for i in range(30)], "x string"), "x").count() == 15
    series = frame([({"p": 1, "q": 2},)], "m map<string,int>")
    assert sorted(tuple(r) for r in charts.map_chart(series, "m").collect()) == [("p", 1), ("q", 2)]


def test_documents_are_validated(spark, tmp_path):
    for name, content in {"good.PDF": b"%PDF-1.7 x", "same.pdf": b"%PDF-1.7 x", "fake.pdf": b"hello", "a b.txt": b"%PDF"}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["filename"]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert {n: r["reject_reason"] for n, r in rows.items()} == {
        "good.PDF": None, "same.pdf": None, "fake.pdf": "invalid header", "a_b.txt": "unsupported format"}
    assert rows["good.PDF"]["content_hash"] == rows["same.pdf"]["content_hash"] and len(rows["good.PDF"]["content_hash"]) == 64
    assert rows["good.PDF"]["valid"] and rows["good.PDF"]["size"] == 10


def test_large_and_empty_documents_are_refused(spark, monkeypatch):
    monkeypatch.setattr(documents, "MAX_BYTES", 8)
    rows = [("x.pdf", bytearray(b"%PDF-long enough")), ("y.pdf", bytearray()), ("z.pdf", None)]
    df = documents.validate_documents(spark.createDataFrame(rows, "path string, content binary"))
    assert [r["reject_reason"] for r in df.orderBy("path").collect()] == ["document too large", "empty document", "empty document"]


def test_tickets(spark, write):
    issues = [
        {"number": 1, "created_at": "2024", "title": "T", "body": "l1\nl2" + "x" * 300, "state": "open",
         "labels": [{"name": "bug"}, {"name": "ui"}], "assignees": [{"login": "ann"}]},
        {"number": 2, "created_at": "2024", "title": "U", "body": None, "state": "closed", "labels": [], "assignees": []},
        {"number": 3, "created_at": "2024", "title": "PR", "body": "", "state": "open", "labels": [], "assignees": [], "pull_request": {"url": "u"}},
    ]
    df = spark.read.schema(feeds.ISSUE_SCHEMA).option("multiLine", True).json(write(json.dumps(issues), "i.json"))
    rows = {r["Ticket ID"]: r for r in feeds.tickets(df).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["Labels"] == "bug, ui" and rows[1]["Assignee"] == "ann"
    assert rows[1]["Description"] == "l1 l2" + "x" * 195 + "..."
    assert (rows[2]["Labels"], rows[2]["Assignee"], rows[2]["Description"]) == ("None", "Unassigned", "...")


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    for i, name in enumerate(("one", "two")):
        df = spark.range(3 + i).withColumn("x", F.lit(None).cast("string") if i else F.lit("x"))
        registry.register(profiles.profile_table(df, name, f"{name}.csv", f"2024-01-0{i + 1}"), path)
    held = registry.read_registry(spark, path)
    listed = registry.list_datasets(held).collect()
    assert [(r["dataset_id"], r["row_count"], r["missing_percentage"]) for r in listed] == [("two", 4, 50.0), ("one", 3, 0.0)]
    assert registry.latest_dataset(held).first()["dataset_id"] == "two"
    assert registry.resolve_dataset(held) == "two" and registry.resolve_dataset(held, " one ") == "one"
    stored = json.loads(registry.find_dataset(held, "one").first()["profile_json"])
    assert stored["quality"]["rows"] == 3 and [c["name"] for c in stored["columns"]] == ["id", "x"]
    with pytest.raises(AnalyticsError, match="DATASET_NOT_FOUND"):
        registry.find_dataset(held, "three")
    assert registry.delete_dataset(spark, path, "two") is True
    assert registry.delete_dataset(spark, path, "two") is False
    assert [r["dataset_id"] for r in registry.list_datasets(registry.read_registry(spark, path)).collect()] == ["one"]
    for name, code in (("three", "DATASET_NOT_FOUND"), ("one", "DATASET_LOAD_ERROR")):
        with pytest.raises(AnalyticsError, match=code):
            registry.load_dataset(held, name)
    gone = held.withColumn("location", F.lit(str(tmp_path / "gone.csv"))).withColumn("file_type", F.lit("csv"))
    with pytest.raises(AnalyticsError, match="DATASET_READ_ERROR"):
        registry.load_dataset(gone, "one")
    (tmp_path / "kept.csv").write_text("a,a\n1,x\n")
    kept = gone.withColumn("location", F.lit(str(tmp_path / "kept.csv")))
    assert registry.load_dataset(kept, "one").columns == ["a", "a_1"]
    unscored = held.withColumn("quality_score", F.lit(None).cast("double")).withColumn("missing_percentage", F.lit(None).cast("double"))
    assert {(r["quality_score"], r["missing_percentage"]) for r in registry.list_datasets(unscored).collect()} == {(100.0, 0.0)}


def test_line_ends_inside_quotes_belong_to_the_cell(spark, write):
    df = tables.read_csv(spark, write('id,note\n1,"x\ny"\n2,z\n3,"say ""hi"", then\nleave"\n'))
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, "z"), (3, 'say "hi", then\nleave')]


def test_rows_equal_to_a_promoted_header_stay(spark, write):
    df = tables.read_csv(spark, write("Unnamed: 0,Unnamed: 1\nCity,People\nRome,3\nCity,People\nCity,People\n"))
    assert sorted(map(tuple, df.collect())) == [("City", "People"), ("City", "People"), ("Rome", "3")]


def test_a_promoted_header_goes_from_every_file(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part{i}.csv").write_text("Unnamed: 0,b\nk,v\n" + "".join(f"{i},{j}\n" for j in range(i)))
    df = tables.read_csv(spark, str(tmp_path))
    assert df.columns == ["k", "v"] and df.count() == 10
