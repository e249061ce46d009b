"""Dashboard: every insight section of a repository in one row."""

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import insights as I
from ..operators.grouping import nested
from ..operators.history import complexity_trends
from ..operators.hotspot_model import file_scores, subsystem_scores
from ..session import cut_lineage


def _section(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """Array per repository of a section with a fixed small number of rows."""
    return rows.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def dashboard(commits: DataFrame, file_changes: DataFrame, head_files: DataFrame | None = None,
              as_of: Column | None = None, model: PipelineModel | None = None) -> DataFrame:
    """One row per repository.

    With a ``model`` health and alerts use its scores, without one the rule scores. Alerts and risk areas
    hold at most ten rows, the forecasts at most three, the health of subsystems one per folder.

    The per-file trends and the totals are written once to the shared folder: five sections read them.
    """
    stamp = F.current_timestamp() if as_of is None else as_of
    trends = cut_lineage(complexity_trends(commits, file_changes))
    totals = cut_lineage(I.repo_totals(commits, trends))
    rollup = I.subsystem_rollup(commits, file_changes)
    health = nested(
        I.subsystem_health(rollup, stamp, subsystem_scores(model, rollup)), ["repo_id"], F.struct("name", "status", "complexity_trend", "last_updated"), "subsystem_health")
    alerts = _section(I.refactor_alerts(trends, file_scores(model, trends)), "refactor_alerts", "rank", "file_path",
                      "reason", "severity", "suggested_action", "estimated_effort")
    risks = _section(I.risk_areas(trends), "risk_areas", "rank", "area_name", "risk_level",
                     "potential_impact", "mitigation_strategy")
    metrics = I.codebase_metrics(commits, trends, head_files, stamp, totals).select(
        "repo_id", F.struct("total_files", "total_commits", "average_complexity",
                            "technical_debt_ratio", "code_quality_score",
                            "last_analyzed").alias("codebase_metrics"))
    resources = _section(I.resource_forecast(commits), "resource_predictions", "resource_type",
                         "predicted_need", "confidence_score", "timeframe")
    upkeep = _section(I.maintenance_forecast(totals), "maintenance_predictions", "maintenance_type",
                      "predicted_frequency", "timeframe", "confidence_score")
    outlook = _section(I.complexity_forecast(totals), "complexity_predictions", "component",
                       "predicted_complexity", "trend", "confidence_score")
    base = metrics
    for section in (alerts, risks, resources, upkeep, outlook):
        base = base.join(section, "repo_id", "left")
    joined = base.join(health, "repo_id", "left")
    empty = {f.name: F.array().cast(f.dataType) for f in joined.schema
             if f.dataType.typeName() == "array"}
    filled = [F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in joined.columns]
    return joined.select(*filled).select(
        "repo_id", "subsystem_health", "refactor_alerts", "codebase_metrics",
        "resource_predictions", "risk_areas", "maintenance_predictions",
        "complexity_predictions", stamp.alias("generated_at"))


def insights_document(dash: DataFrame) -> DataFrame:
    """The dashboard and its sections in the layout of the exported JSON document."""
    return dash.select(
        "repo_id", F.struct(*[c for c in dash.columns if c != "repo_id"]).alias("dashboard"),
        "subsystem_health", "refactor_alerts", F.col("codebase_metrics").alias("metrics"),
        F.struct(F.col("resource_predictions").alias("resource"),
                 F.col("maintenance_predictions").alias("maintenance"),
                 F.col("complexity_predictions").alias("complexity")).alias("predictions"),
        "risk_areas")
