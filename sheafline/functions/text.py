"""Text columns: cleaning, hashing, file names, previews, model-output JSON, answer sections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space at the ends of a text, as code ranges.
WHITE_SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
    (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITE_SPACE = "".join(chr(code) for low, high in WHITE_SPACE_RANGES for code in range(low, high + 1))

# Longest text that is compared and shuffled as itself; longer ones travel as their digest.
SHORT_TEXT = 64


def trim_blank(text: Column) -> Column:
    """Strip all leading and trailing white space, line ends included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_text(text: Column) -> Column:
    """Remove control characters except tab, line feed and carriage return, then strip."""
    return trim_blank(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content, 256)


def identity_key(value: Column, dtype: T.DataType) -> Column:
    """A short stand-in with the same equality as ``value``.

    Long texts become ``#`` plus their SHA-256 (65 characters, so never equal to a text kept as
    itself); grouping by it shuffles tens of bytes per row instead of whole documents.
    """
    if isinstance(dtype, T.StringType):
        digest = F.concat(F.lit("#"), F.sha2(value, 256))
        return F.when(F.length(value) > SHORT_TEXT, digest).otherwise(value)
    if isinstance(dtype, T.BinaryType):
        return F.sha2(value, 256)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.sha2(F.to_json(F.struct(value.alias("v"))), 256)
    return value


def safe_filename(name: Column, default: str = "dataset") -> Column:
    """Last path segment (either slash) with every unusual character replaced by ``_``."""
    base = F.regexp_replace(name, r"^(?s).*[/\\]", "")
    cleaned = F.regexp_replace(base, r"[^a-zA-Z0-9_.-]", "_")
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(F.lit(default))


def preview_text(text: Column, length: int = 200) -> Column:
    """First characters on one line, followed by an ellipsis."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, length)
    return F.concat(F.translate(head, "\n", " "), F.lit("..."))


def list_text(items: Column, default: str) -> Column:
    """``a, b`` for a list of texts; the default when there are none."""
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit(default))


def argument_text(value: Column) -> Column:
    """Lower-cased, trimmed argument; blank counts as missing."""
    tidy = F.lower(F.trim(value))
    return F.when(F.length(tidy) > 0, tidy)


def fenced_json(text: Column) -> Column:
    """The JSON part of a model reply: fences dropped, then first ``{`` to last ``}``."""
    body = F.regexp_replace(trim_blank(text), r"^```(?:json)?|```$", "")
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.length(inner) > 0, inner).otherwise(trim_blank(body))


def _merge_objects(text: str | None) -> str | None:
    """All JSON objects found in a text, later keys winning; None when there are none."""
    if text is None:
        return None
    decoder, merged, at = json.JSONDecoder(), {}, text.find("{")
    try:
        while at >= 0:
            found, at = decoder.raw_decode(text, at)
            merged.update(found)
            at = text.find("{", at)
    except json.JSONDecodeError:
        return None
    return json.dumps(merged, ensure_ascii=False) if merged else None


@F.pandas_udf(T.StringType())
def _merge_objects_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_merge_objects)


def merged_json(text: Column) -> Column:
    """One JSON object holding every object of a model reply, or NULL.

    A reply with a single brace pair is checked by Spark's own parser; only replies with more
    braces go through Python, in Arrow batches.
    """
    body = fenced_json(text)
    braces = F.length(body) - F.length(F.replace(body, F.lit("{"), F.lit("")))
    return F.when(braces == 1, F.when(F.try_parse_json(body).isNotNull(), body)).otherwise(
        _merge_objects_udf(F.when(braces > 1, body))
    )


# The section titles of an answer.
SECTION_TITLES = {
    "data_findings": "DATA FINDINGS",
    "document_evidence": "DOCUMENT EVIDENCE",
    "interpretation": "AI INTERPRETATION",
    "citations": "CITATIONS",
}


def answer_sections(text: Column) -> dict[str, Column]:
    """The sections of an answer text and its forecast/anomaly flags, keyed by column name."""
    title = "|".join(SECTION_TITLES.values())
    stop = rf"(?=\n?#{{3}}[^\n]*(?:{title})|\*\*Sources:\*\*|\z)"
    columns = {}
    for name, heading in SECTION_TITLES.items():
        start = rf"(?:#{{3}}[^\n]*{heading}[^\n]*\n"
        if name == "data_findings":
            start += rf"|📊\s*\*\*{heading}[^\n]*\n"
        if name == "citations":
            body = F.regexp_extract(text, rf"(?is){start}|\*\*Sources:\*\*\n)(.*)\z", 1)
        else:
            body = F.regexp_extract(text, rf"(?is){start})(.*?){stop}", 1)
        columns[name] = F.coalesce(trim_blank(body), F.lit(""))
    lowered = F.lower(text)
    columns["is_forecast"] = F.coalesce(
        text.contains("DATA FINDINGS (FORECAST)")
        | lowered.contains("time-series forecast")
        | lowered.contains("projected estimates"),
        F.lit(False),
    )
    columns["is_anomaly"] = F.coalesce(
        text.contains("Statistical Anomaly Detection")
        | text.contains("Identified Outliers")
        | text.contains("IQR Method"),
        F.lit(False),
    )
    return columns
