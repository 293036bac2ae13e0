"""CSV and JSON in, CSV out."""

from __future__ import annotations

import csv
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.errors import AnalyticsError
from sheafline.functions.numbers import parse_number
from sheafline.operators.cleanup import flatten
from sheafline.operators.columns import column
from sheafline.sources.records import first_records, quoted_records, quotes_in

# The texts that mean "missing" in a CSV cell.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS, FALSE_TOKENS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
INTEGER_PATTERN = r"^\s*[+-]?\d{1,19}\s*$"


def normalize_headers(headers: Sequence[str]) -> list[str]:
    """Trimmed, never blank, never repeated: blank or ``Unnamed...`` headers are numbered by
    position, repeats get ``_1``, ``_2`` and so on until they are unique."""
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    names = []
    for position, header in enumerate(headers, start=1):
        base = str(header if header is not None else "").strip()
        if not base or base.lower().startswith("unnamed"):
            base = f"column_{position}"
        name = base
        while name in taken:
            repeats[base] = repeats.get(base, 0) + 1
            name = f"{base}_{repeats[base]}"
        taken.add(name)
        names.append(name)
    return names


def normalize_columns(df: DataFrame) -> DataFrame:
    """The table with normalised headers; only metadata changes."""
    return df.toDF(*normalize_headers(df.columns))


# How cells are read, by the file reader and record by record alike.
CELLS = {
    "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "",
    "nullValue": "\u0000", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw",
}
#: The column that holds what rows have beyond the header, if it is asked for.
EXTRA_CELLS = "extra_cells"


def _header_cells(spark: SparkSession, path: str, encoding: str, delimiter: str, row: int, quoted: bool) -> list[str]:
    """Cells of the first (or second) record of a file, without reading much further."""
    found = first_records(spark, path, encoding, row + 1, quoted)
    if len(found) <= row:
        raise AnalyticsError("EMPTY_DATASET", "The file has no header line.")
    return next(csv.reader([found[row]], delimiter=delimiter, strict=False)) if "\n" not in found[row] else next(
        csv.reader(found[row].splitlines(keepends=True), delimiter=delimiter))


def extra_cells(raw: Column, width: int, delimiter: str) -> Column:
    """The cells of a record beyond ``width``: an empty array where there are none, NULL for NULL."""

    @F.arrow_udf("array<string>")
    def beyond(records: pa.Array) -> pa.Array:
        cells = [None if r is None else next(csv.reader(r.splitlines(keepends=True) or [""], delimiter=delimiter), [])[width:] for r in records.to_pylist()]
        return pa.array(cells, pa.list_(pa.string()))

    return beyond(raw)


def _without_first_record(df: DataFrame) -> DataFrame:
    """Rows of a file source but the first of each file: the one with the least row number in the file's first split."""
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"),
                             "_row": F.monotonically_increasing_id()})
    first = placed.filter(F.col("_at") == 0).groupBy(F.col("_file").alias("_f")).agg(F.min("_row").alias("_r"))
    kept = placed.join(first, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")), "left_anti")
    return kept.drop("_file", "_at", "_row")


def infer_column(text: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~text.isin(*tokens), text)


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    infer: bool = True,
    header_row: int | None = None,
    multiline: bool | None = None,
    wide_rows: str = "refuse",
) -> DataFrame:
    """A CSV table with normalised headers and inferred column types.

    Every cell is read as text, so all files agree on one schema. Bytes that are not UTF-8 make
    the whole table be read as Latin-1. A column is BOOLEAN, LONG or DOUBLE when every present
    cell is; otherwise it stays text (dates are recognised where they are used).
    ``header_row=1`` takes the second record as header; by default it is taken when the first
    has a cell that starts with ``Unnamed``; it is taken out of each file by its place, so data rows
    equal to it stay. Line ends inside quotes belong to the cell, in the header too: a line with an odd number of quotes shows
    that there are some, and then records are found by the parity of quotes, all splits of all files in parallel;
    ``multiline`` says so beforehand. Rows with fewer cells than the header end in NULLs. Rows with more are counted and refused with
    ``WIDE_ROWS``; ``wide_rows="keep"`` reads them and puts what is beyond the header into the array ``extra_cells``.
    """
    if wide_rows not in ("refuse", "keep"):
        raise AnalyticsError("INVALID_ARGUMENT", "wide_rows is 'refuse' or 'keep'.")
    raw = spark.read.text(path)
    broken, open_ = raw.agg(F.count_if(~F.is_valid_utf8("value")), F.count_if(quotes_in(F.col("value")) % 2 == 1)).first()
    encoding = "ISO-8859-1" if broken else "UTF-8"
    quoted = bool(open_) if multiline is None else multiline
    first = _header_cells(spark, path, encoding, delimiter, 0, quoted)
    if header_row is None:
        promoted = any("Unnamed" in (cell or "") for cell in first) and len(raw.take(2)) > 1
        header_row = 1 if promoted else 0
    cells = first if header_row == 0 else _header_cells(spark, path, encoding, delimiter, header_row, quoted)
    if header_row:
        cells += [None] * (len(first) - len(cells))
    names = normalize_headers(cells)
    fields = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{f} string" for f in fields)

    def read(schema: str, **options) -> DataFrame:
        held = spark.read.options(**CELLS, encoding=encoding, sep=delimiter, header=True, enforceSchema=True, **options).schema(schema).csv(path)
        return _without_first_record(held) if header_row else held

    if quoted:
        records = quoted_records(spark, path, encoding).where(~(F.col("first") & (F.col("ordinal") <= header_row)))
        options = {**CELLS, "sep": delimiter, "multiLine": "true"}
        parsed = records.select(F.from_csv("value", F.lit(f"{schema}, _raw string"), options).alias("_r")).select("_r.*")
    else:
        # A pruned scan would compare the width of rows with that of the columns asked for.
        parsed = read(f"{schema}, _raw string", columnPruning=False)
    named = [infer_column(F.col(f)).alias(n) for f, n in zip(fields, names)]
    typed, odd = _types(parsed.select(*named, "_raw"), names if infer else [])
    shown = [typed.get(n, column(n)).alias(n) for n in names]
    beyond = extra_cells(F.col("_raw"), len(names), delimiter)
    if wide_rows == "keep":
        surplus = F.coalesce(beyond, F.array().cast("array<string>")) if odd else F.array().cast("array<string>")
        return parsed.select(*named, surplus.alias(EXTRA_CELLS)).select(*shown, EXTRA_CELLS)
    if odd:
        # Rows of another width than the header's: shorter ones are read, longer ones are not.
        count = parsed.where(F.col("_raw").isNotNull()).agg(F.count_if(F.size(beyond) > 0), F.count(fields[0])).first()[0]
        if count:
            raise AnalyticsError("WIDE_ROWS", f"{count} rows have more cells than the {len(names)} of the header.")
    return (parsed if quoted else read(schema)).select(*named).select(*shown)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as BOOLEAN, LONG or DOUBLE where every present cell allows it (one aggregate)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    typed, _ = _types(df.select(*[column(c) for c in texts], F.lit(None).cast("string").alias("_raw")), texts)
    return df.select([typed.get(c, column(c)).alias(c) for c in df.columns])


def _types(df: DataFrame, texts: Sequence[str]) -> tuple[dict[str, Column], int]:
    """The text columns that are of another type as expressions, and how many rows have a ``_raw`` (the last column)."""
    checks = []
    for c in texts:
        cell = column(c)
        whole = F.when(cell.rlike(INTEGER_PATTERN), F.trim(cell).try_cast("long"))
        checks.append(F.struct(
            F.count(cell), F.count_if(cell.isin(*TRUE_TOKENS, *FALSE_TOKENS)), F.count(whole), F.count(parse_number(cell)),
        ))
    # A file source does not look at the raw record alone.
    *counts, odd, _ = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)], F.count("_raw").alias("odd"), F.count(column(df.columns[0]))).first()
    typed = {}
    for c, (present, flags, wholes, numbers) in zip(texts, counts):
        cell = column(c)
        if not present:
            continue
        if flags == present:
            typed[c] = F.when(cell.isNotNull(), cell.isin(*TRUE_TOKENS))
        elif wholes == present:
            typed[c] = F.trim(cell).try_cast("long")
        elif numbers == present:
            typed[c] = parse_number(cell)
    return typed, odd


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header and no index column."""
    df.write.mode(mode).options(header=True, escape='"', timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """JSON objects (an array of them, or one per line) with nested objects as dotted columns."""
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return flatten(reader.json(path))
