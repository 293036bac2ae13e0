"""CSV records over line ends and splits, header records, and rows wider than the header."""

import csv
import io
import random

import pytest

from sheafline.errors import AnalyticsError
from sheafline.sources import records, tables


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that cells lie over several."""
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "64"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.fixture
def write(tmp_path):
    def put(text, name="t.csv"):
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path / name)

    return put


def table_text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


def cells(rnd):
    kinds = ["plain", 'say "hi", then', "a\nb", "x\r\ny", "\n\n", '"', ",", "é世", "line\n" * rnd.randint(1, 120), " pad "]
    return [f"r{rnd.randint(0, 9)}{rnd.choice(kinds)}" for _ in range(2)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_splits_are_those_of_a_plain_reader(spark, small_splits, write, tmp_path, end):
    rnd = random.Random(5)
    rows = [[str(i), *cells(rnd)] for i in range(150)]
    path = write(table_text([["id", "one", "two"], *rows], end))
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    got = tables.read_csv(spark, path, infer=False)
    assert got.columns == ["id", "one", "two"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows))


def test_many_splits_inside_cells_are_dealt_by_split(spark, small_splits, write, monkeypatch):
    rnd = random.Random(6)
    rows = [[str(i), *cells(rnd)] for i in range(120)]
    path = write(table_text([["id", "one", "two"], *rows]))
    monkeypatch.setattr(records, "BROADCAST_SPLITS", 0)
    assert sorted(map(tuple, tables.read_csv(spark, path, infer=False).collect())) == sorted(map(tuple, rows))


def test_several_files_lose_their_own_header(spark, small_splits, tmp_path):
    rnd = random.Random(7)
    folder = tmp_path / "many"
    folder.mkdir()
    every = []
    for f in range(4):
        rows = [[f"{f}-{i}", *cells(rnd)] for i in range(20 * f)]
        every += rows
        (folder / f"{f}.csv").write_text(table_text([["id", "first\nname", "two"], *rows]))
    got = tables.read_csv(spark, str(folder), infer=False)
    assert got.columns == ["id", "first\nname", "two"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every))


def test_a_header_with_line_ends_keeps_all_columns(spark, write):
    df = tables.read_csv(spark, write('"a\nb",c,"d,\n""e"""\n1,2,3\n3,4,5\n'))
    assert df.columns == ["a\nb", "c", 'd,\n"e"'] and sorted(map(tuple, df.collect())) == [(1, 2, 3), (3, 4, 5)]
    promoted = tables.read_csv(spark, write('Unnamed: 0,"Title\nof it"\n"a\nb",c\n1,2\n'))
    assert promoted.columns == ["a\nb", "c"] and [tuple(r) for r in promoted.collect()] == [(1, 2)]


def test_rows_wider_than_the_header_are_refused_or_kept_whole(spark, write):
    plain = write("a,b\n1,2\n3,4,5\n6\n7,8,,\"9,\"\"x\"\n1,1,\n")
    with pytest.raises(AnalyticsError, match="WIDE_ROWS.*3 rows have more cells than the 2"):
        tables.read_csv(spark, plain)
    with pytest.raises(AnalyticsError, match="WIDE_ROWS"):
        tables.read_csv(spark, plain, infer=False)
    kept = tables.read_csv(spark, plain, wide_rows="keep")
    assert sorted((r["a"], r["b"], r["extra_cells"]) for r in kept.fillna(0, ["b"]).collect()) == [
        (1, 1, [""]), (1, 2, []), (3, 4, ["5"]), (6, 0, []), (7, 8, ["", '9,"x'])]
    quoted = write('a,b\n"1\n0",2\n3,4,"5\n6",7\n')
    with pytest.raises(AnalyticsError, match="1 rows"):
        tables.read_csv(spark, quoted)
    assert sorted(map(tuple, tables.read_csv(spark, quoted, wide_rows="keep").collect())) == [("1\n0", 2, []), ("3", 4, ["5\n6", "7"])]
    narrow = tables.read_csv(spark, write("a,b\n1,2\n3\n"), wide_rows="keep")
    assert sorted((r["a"], r["extra_cells"]) for r in narrow.collect()) == [(1, []), (3, [])]
    with pytest.raises(AnalyticsError, match="INVALID_ARGUMENT"):
        tables.read_csv(spark, plain, wide_rows="cut")


def test_blank_lines_latin1_marks_and_open_quotes(spark, write):
    df = tables.read_csv(spark, write('﻿id,t\n\n1,"a\n\nb"\n   \n2,c\n\n'))
    assert df.columns == ["id", "t"] and sorted(map(tuple, df.collect())) == [(1, "a\n\nb"), (2, "c")]
    latin = tables.read_csv(spark, write('id,t\n1,"caf\xe9\nnoir"\n'.encode("latin-1")))
    assert [tuple(r) for r in latin.collect()] == [(1, "café\nnoir")]
    with pytest.raises(AnalyticsError, match="DATASET_LOAD_ERROR"):
        tables.read_csv(spark, write('a,b\n1,"2\n3,4\n'))
    only = tables.read_csv(spark, write('"a\nb",c\n'))
    assert only.columns == ["a\nb", "c"] and only.count() == 0
