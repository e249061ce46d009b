"""Rule-based commit stories."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from ..functions.paths import component
from .grouping import nested
from .history import COMMIT, change_metrics


def affected_components(file_changes: DataFrame) -> DataFrame:
    """Distinct second path segments per commit, sorted."""
    names = (file_changes.select(*COMMIT, component(F.col("file_path")).alias("component"))
             .filter(F.col("component").isNotNull()).distinct())
    return names.groupBy(*COMMIT).agg(F.array_sort(F.collect_list("component")).alias("components"))


def impact_totals(changes: DataFrame) -> DataFrame:
    """Lines, complexity change and files per commit, from ``change_metrics`` rows."""
    return changes.groupBy(*COMMIT).agg(
        F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("lines_changed"),
        F.sum(F.col("complexity_after") - F.col("complexity_before")).alias("complexity_delta"),
        F.count(F.lit(1)).alias("files_changed"))


def commit_story(commits: DataFrame, file_changes: DataFrame, summary: Column | None = None) -> DataFrame:
    """Purpose, system impact and components per commit.

    ``summary``: a column of ``commits`` to tell the story with; the lead line by default.
    """
    changes = change_metrics(file_changes)
    totals = impact_totals(changes)
    names = affected_components(changes)
    zero = F.lit(0).cast("long")
    level = rules.impact_level(F.coalesce("lines_changed", zero), F.coalesce("complexity_delta", F.lit(0.0)),
                               F.coalesce("files_changed", zero))
    parts = F.coalesce("components", F.array().cast("array<string>"))
    told = rules.lead_summary(F.col("message")) if summary is None else summary
    return (commits.select(*COMMIT, "message", told.alias("summary"))
            .join(totals, COMMIT, "left").join(names, COMMIT, "left")
            .select(*COMMIT,
                    rules.purpose(rules.commit_type(F.col("message")), F.col("summary"), parts).alias("purpose"),
                    rules.impact_description(level).alias("system_impact"),
                    parts.alias("affected_components")))


def change_labels(file_changes: DataFrame) -> DataFrame:
    """Sorted ``"{type} in {path}"`` labels per commit."""
    rows = change_metrics(file_changes)
    label = F.concat("change_type", F.lit(" in "), "file_path")
    return nested(rows, COMMIT, label, "labels")


def importance_texts(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Text to embed per commit: the message and what was done to each file."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    return (commits.select(*COMMIT, "message").join(change_labels(file_changes), COMMIT, "left")
            .select(*COMMIT, rules.importance_text(F.col("message"), labels).alias("text")))
