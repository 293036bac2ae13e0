"""Issue feeds as flat ticket tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import list_text, preview_text

# Fixed value: the part of an issue feed that the ticket table needs.
ISSUE_SCHEMA = (
    "number long, created_at string, title string, body string, state string, "
    "labels array<struct<name: string>>, assignees array<struct<login: string>>, pull_request struct<url: string>"
)


def tickets(issues: DataFrame) -> DataFrame:
    """One row per issue; pull requests are left out."""
    names = F.transform("labels", lambda label: label["name"])
    people = F.transform("assignees", lambda user: user["login"])
    return issues.filter(F.col("pull_request").isNull()).select(
        F.col("number").alias("Ticket ID"),
        F.col("created_at").alias("Created Date"),
        F.col("title").alias("Title"),
        preview_text(F.col("body")).alias("Description"),
        F.col("state").alias("Status"),
        list_text(people, "Unassigned").alias("Assignee"),
        list_text(names, "None").alias("Labels"),
    )
