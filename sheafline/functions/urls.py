"""URL columns: spreadsheet share links, supported links, repository names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sharing address of online spreadsheets and its CSV export form.
SHEET_ADDRESS = "docs.google.com/spreadsheets/d/"
SHEET_EXPORT = "https://docs.google.com/spreadsheets/d/{id}/export?format=csv"


def sheet_export_url(url: Column) -> Column:
    """A sharing link becomes its CSV export link; other links stay."""
    sheet_id = F.regexp_extract(url, r"/d/([a-zA-Z0-9_-]+)", 1)
    head, tail = SHEET_EXPORT.split("{id}")
    export = F.concat(F.lit(head), sheet_id, F.lit(tail))
    return F.when(url.contains(SHEET_ADDRESS) & (F.length(sheet_id) > 0), export).otherwise(url)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def is_supported_url(url: Column) -> Column:
    """A link can be fetched when it has a scheme and a host."""
    return F.coalesce(F.length(url_host(url)) > 0, F.lit(False))


def link_kind(url: Column) -> Column:
    """``sheet``, ``raw``, ``csv``, ``json`` or ``other``; NULL for unsupported links."""
    path = F.lower(url_path(url))
    kind = (
        F.when(url.contains("docs.google.com/spreadsheets"), "sheet")
        .when(url.contains("raw.githubusercontent.com"), "raw")
        .when(path.endswith(".csv"), "csv")
        .when(path.endswith(".json"), "json")
        .otherwise("other")
    )
    return F.when(is_supported_url(url), kind)


def repository_owner(url: Column) -> Column:
    owner = F.regexp_extract(url, r"github\.com/([^/]+)/([^/]+)", 1)
    return F.when(F.length(owner) > 0, owner)


def repository_name(url: Column) -> Column:
    name = F.regexp_extract(url, r"github\.com/([^/]+)/([^/]+)", 2)
    return F.when(F.length(name) > 0, F.replace(name, F.lit(".git"), F.lit("")))
