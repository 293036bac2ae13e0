"""The full profile of a table, its summary, and the columns a dashboard starts with."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.profile import profile_columns
from sheafline.operators.quality import table_quality


class Profile(NamedTuple):
    """Three small tables: one row about the table, one about its quality, one per column."""

    dataset: DataFrame
    quality: DataFrame
    columns: DataFrame


def profile_table(
    df: DataFrame,
    dataset_id: str,
    filename: str = "",
    uploaded_at: str | None = None,
    file_type: str = "parquet",
    file_size: int | None = None,
    location: str | None = None,
    approx: bool = False,
) -> Profile:
    stamp = F.lit(uploaded_at) if uploaded_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    dataset = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(filename).alias("original_filename"),
        F.lit(file_type).alias("file_type"),
        F.lit(file_size).cast("long").alias("file_size"),
        F.lit(location).cast("string").alias("location"),
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        stamp.alias("upload_timestamp"),
    )
    return Profile(dataset, table_quality(df), profile_columns(df, approx))


def table_summary(profile: Profile) -> DataFrame:
    """One row: sizes, column names by kind in column order, and the main quality figures.

    Boolean, text and unknown columns all count as text columns.
    """
    kind = F.col("semantic_type")

    def names(condition) -> Column:
        held = F.collect_list(F.when(condition, F.struct("ordinal", "name")))
        return F.transform(F.array_sort(held), lambda c: c["name"])

    columns = profile.columns.agg(
        names(F.lit(True)).alias("columns"),
        names(kind == "numeric").alias("numeric_columns"),
        names(kind == "categorical").alias("categorical_columns"),
        names(kind == "datetime").alias("datetime_columns"),
        names(~kind.isin("numeric", "categorical", "datetime")).alias("text_columns"),
    )
    lists = columns.select(F.struct("*").alias("c")).scalar()
    quality = profile.quality.select(
        F.struct("missing_cells", "missing_percentage", "duplicate_rows", "duplicate_percentage",
                 F.col("score").alias("quality_score"))
    ).scalar()
    return profile.dataset.withColumn("c", lists).withColumn("q", quality).select(
        "dataset_id", "original_filename", "row_count", "column_count", "c.*", "q.*"
    )


def business_metrics(columns: DataFrame) -> DataFrame:
    """Numeric columns that are not identifiers; all numeric columns when every one is."""
    numeric = columns.filter(F.col("semantic_type") == "numeric").select("ordinal", "name", "is_identifier")
    any_business = numeric.agg(F.coalesce(F.bool_or(~F.col("is_identifier")), F.lit(False))).scalar()
    return numeric.filter(~F.col("is_identifier") | ~any_business).select("ordinal", "name")


def default_columns(columns: DataFrame) -> DataFrame:
    """One row ``(metric, category, date)``: the first column of each role."""
    first_metric = business_metrics(columns).agg(F.min_by("name", "ordinal")).scalar()

    def first(kind: str):
        return F.min_by(F.when(F.col("semantic_type") == kind, F.col("name")),
                        F.when(F.col("semantic_type") == kind, F.col("ordinal")))

    return columns.agg(first("categorical").alias("category"), first("datetime").alias("date")).select(
        first_metric.alias("metric"), "category", "date"
    )
