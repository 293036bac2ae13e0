"""The registry of profiled tables: an append-only log, so concurrent writers and retries are safe.

A registration appends one row, a deletion appends a tombstone, and readers take the last entry of
each dataset.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.errors import AnalyticsError
from sheafline.plans.profile import Profile
from sheafline.sources.tables import normalize_columns, read_csv, read_json

DEFAULT_SCORE = 100.0
ENTRY = (
    "dataset_id string, original_filename string, file_type string, file_size long, location string, row_count long, "
    "column_count long, upload_timestamp string, quality_score double, missing_percentage double, "
    "profile_json string, deleted boolean, logged_at timestamp"
)


def registry_entry(profile: Profile) -> DataFrame:
    """A profile as one registry row; the quality and column tables travel as JSON."""
    quality = profile.quality.select(F.struct("*").alias("q")).scalar()
    columns = profile.columns.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("c")).scalar()
    return profile.dataset.withColumn("_q", quality).select(
        "dataset_id", "original_filename", "file_type", "file_size", "location", "row_count", "column_count",
        "upload_timestamp", F.col("_q.score").alias("quality_score"), F.col("_q.missing_percentage").alias("missing_percentage"),
        F.to_json(F.struct(F.col("_q").alias("quality"), columns.alias("columns"))).alias("profile_json"),
        F.lit(False).alias("deleted"), F.current_timestamp().alias("logged_at"),
    )


def register(profile: Profile, path: str) -> None:
    registry_entry(profile).write.mode("append").parquet(path)


def _current(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema(ENTRY).parquet(path)
    latest = log.groupBy("dataset_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "dataset_id"]), "logged_at").alias("e"))
    return latest.select("dataset_id", "e.*").filter(~F.col("deleted")).drop("deleted", "logged_at")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registered datasets that are not deleted."""
    return _current(spark, path)


def list_datasets(registry: DataFrame) -> DataFrame:
    """Newest first; a missing score counts as 100 and a missing percentage as 0."""
    listed = registry.select(
        "dataset_id", "original_filename", "file_type", "file_size", "row_count", "column_count", "upload_timestamp",
        F.coalesce("quality_score", F.lit(DEFAULT_SCORE)).alias("quality_score"),
        F.coalesce("missing_percentage", F.lit(0.0)).alias("missing_percentage"),
    )
    return listed.orderBy(F.desc("upload_timestamp"), "dataset_id")


def find_dataset(registry: DataFrame, dataset_id: str) -> DataFrame:
    """The registry row of a dataset; fails with ``DATASET_NOT_FOUND``."""
    found = registry.filter(F.col("dataset_id") == dataset_id)
    if found.isEmpty():
        raise AnalyticsError("DATASET_NOT_FOUND", f"Dataset {dataset_id!r} is not registered.")
    return found


def load_dataset(registry: DataFrame, dataset_id: str) -> DataFrame:
    """The table of a registered dataset, with normalised headers.

    Fails with ``DATASET_NOT_FOUND`` for an unknown id, ``DATASET_LOAD_ERROR`` for an entry
    without a location, and ``DATASET_READ_ERROR`` when its files cannot be read.
    """
    entry, spark = find_dataset(registry, dataset_id).first(), registry.sparkSession
    location, kind = entry["location"], entry["file_type"]
    if not location or kind not in ("csv", "json", "parquet"):
        raise AnalyticsError("DATASET_LOAD_ERROR", f"Dataset {dataset_id!r} has no readable location.")
    try:
        if kind == "csv":
            return read_csv(spark, location)
        return normalize_columns(read_json(spark, location) if kind == "json" else spark.read.parquet(location))
    except PySparkException as error:
        raise AnalyticsError("DATASET_READ_ERROR", f"Dataset {dataset_id!r} cannot be read: {error}") from error


def latest_dataset(registry: DataFrame) -> DataFrame:
    """One row ``(dataset_id)``: the newest dataset, NULL in an empty registry."""
    return registry.agg(F.max_by("dataset_id", F.struct("upload_timestamp", "dataset_id")).alias("dataset_id"))


def resolve_dataset(registry: DataFrame, dataset_id: str | None = None) -> str | None:
    """An explicit id as it is, else the newest one."""
    if dataset_id and dataset_id.strip():
        return dataset_id.strip()
    return latest_dataset(registry).first()["dataset_id"]


def delete_dataset(spark: SparkSession, path: str, dataset_id: str) -> bool:
    """Hide a dataset from the registry; False when it was not there."""
    found = _current(spark, path).filter(F.col("dataset_id") == dataset_id)
    if found.isEmpty():
        return False
    kept = [c.split()[0] for c in ENTRY.split(", ")]
    stone = found.withColumns({"deleted": F.lit(True), "logged_at": F.current_timestamp()})
    stone.select(*kept).write.mode("append").parquet(path)
    return True
