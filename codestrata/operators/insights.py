"""Scores, rules and forecasts per repository."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import numbers as N, rules
from ..functions.dates import sunday_week
from ..functions.paths import subsystem
from .grouping import TAG, skew_join, top_per_repo
from .history import COMMIT, FILE, files_per_commit

SUBSYSTEM = ["repo_id", "subsystem"]


def subsystem_touches(commits: DataFrame, file_changes: DataFrame, unit: str = "touch") -> DataFrame:
    """Touch count per subsystem and commit, beside the commit's facts and its whole file count.

    ``unit='commit'`` counts a commit once per subsystem however many files it touches there.
    Everything is joined and counted on the commit keys, so the touches move once.
    """
    facts = commits.select(*COMMIT, "committed_at", "author",
                           rules.mentions_fix(F.col("message")).alias("is_fix"))
    known = facts.join(files_per_commit(file_changes), COMMIT)
    count = F.count(F.lit(1)) if unit == "touch" else F.lit(1).cast("long")
    touched = file_changes.select(*COMMIT, subsystem(F.col("file_path")).alias("subsystem"))
    return (skew_join(touched, known, COMMIT, keep_tag=True)
            .groupBy(*COMMIT, TAG, "subsystem", "committed_at", "author", "is_fix", "n_files")
            .agg(count.alias("touches")).drop(TAG))


def subsystem_rollup(commits: DataFrame, file_changes: DataFrame, min_touches: int = 5,
                     unit: str = "touch") -> DataFrame:
    """Touches, daily frequency, fixes, authors and commit size per subsystem."""
    n, size = F.col("touches"), F.col("n_files")
    when = F.struct("committed_at", "commit_hash")
    totals = subsystem_touches(commits, file_changes, unit).groupBy(*SUBSYSTEM).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("is_fix"), n).otherwise(0)).alias("bug_fixes"),
        F.count_distinct("author").alias("authors"),
        F.sum(n * size).alias("total_files"),
        F.sum(n * size * size).alias("_squares"),
        F.max_by("n_files", when).alias("newest_files"),
        F.min_by("n_files", when).alias("oldest_files"))
    spread = F.col("n").cast("double") * F.col("_squares") - F.col("total_files").cast("double") * F.col("total_files")
    return totals.filter(F.col("n") >= min_touches).select(
        *SUBSYSTEM, "n", (F.col("n") / F.lit(30.0)).alias("frequency"), "bug_fixes", "authors",
        "total_files", (F.col("total_files") / F.col("n")).alias("mean_files"),
        (F.sqrt(F.greatest(spread, F.lit(0.0))) / F.col("n")).alias("std_files"),
        "newest_files", "oldest_files")


def subsystem_trend(chronology: str = "literal") -> Column:
    """``literal`` compares the oldest commit with the newest as if it were the recent one."""
    old, new = F.col("oldest_files"), F.col("newest_files")
    last, first = (old, new) if chronology == "literal" else (new, old)
    return rules.size_trend(last, first, F.col("n"))


def subsystem_health(rollup: DataFrame, as_of: Column | None = None, scores: DataFrame | None = None,
                     chronology: str = "literal") -> DataFrame:
    """Status per subsystem from the rule score, or from ``scores(repo_id, subsystem, score)``."""
    rule = N.subsystem_hotspot_score(F.col("n"), F.col("authors"), F.col("mean_files"))
    if scores is None:
        rows = rollup.withColumn("score", rule)
    else:
        rows = (rollup.join(scores.select(*SUBSYSTEM, F.col("score").alias("_model")), SUBSYSTEM, "left")
                .withColumn("score", F.coalesce("_model", rule)))
    return rows.select(
        "repo_id", F.col("subsystem").alias("name"),
        rules.subsystem_status(F.col("score"), F.col("frequency"), F.col("bug_fixes"), F.col("n")).alias("status"),
        subsystem_trend(chronology).alias("complexity_trend"),
        (F.current_timestamp() if as_of is None else as_of).alias("last_updated"), "score")


def with_file_scores(trends: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Hotspot score per file: the rule, or ``scores(repo_id, file_path, score)`` where given."""
    rule = N.file_hotspot_score(F.col("complexity"), F.col("change_frequency"))
    if scores is None:
        return trends.withColumn("score", rule)
    return (trends.join(scores.select(*FILE, F.col("score").alias("_model")), FILE, "left")
            .withColumn("score", F.coalesce("_model", rule)).drop("_model"))


def refactor_alerts(trends: DataFrame, scores: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Top ``k`` files per repository that call for refactoring, severe ones first."""
    s, c, f = F.col("score"), F.col("complexity"), F.col("change_frequency")
    rows = with_file_scores(trends, scores).filter(rules.needs_refactor(s, c, f)).select(
        *FILE, rules.refactor_reason(s, c, f).alias("reason"),
        rules.alert_severity(s, c).alias("severity"),
        rules.refactor_action(s, c).alias("suggested_action"),
        rules.refactor_effort(c).alias("estimated_effort"))
    return top_per_repo(rows, [F.col("severity") != "high", "file_path"], k)


def risk_areas(trends: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` risky files per repository: high first, then the most recently touched."""
    c, f, r = F.col("complexity"), F.col("change_frequency"), F.col("risk_score")
    rows = (trends.withColumn("risk_score", N.file_risk_score(c, f)).filter(r > 0.5).select(
        "repo_id", F.col("file_path").alias("area_name"), rules.risk_level(r).alias("risk_level"),
        rules.risk_impact(c, f).alias("potential_impact"),
        rules.mitigation(r).alias("mitigation_strategy"), "first_seen"))
    return top_per_repo(rows, [F.col("risk_level") != "high", "first_seen", "area_name"], k)


def commit_totals(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if(rules.is_maintenance(F.col("message"))).alias("maintenance_commits"))


def trend_totals(trends: DataFrame) -> DataFrame:
    c = F.col("complexity")
    return trends.groupBy("repo_id").agg(
        F.avg(c).alias("mean_complexity"), F.count_if(c > 15).alias("over_15"),
        F.count_if(c > 20).alias("over_20"), F.count_if(F.col("first_seen") == 1).alias("newest_files"))


def repo_totals(commits: DataFrame, trends: DataFrame) -> DataFrame:
    """Commit and complexity totals side by side; a repository without files has zeros."""
    zero = F.lit(0).cast("long")
    return commit_totals(commits).join(trend_totals(trends), "repo_id", "left").select(
        "repo_id", "total_commits", "maintenance_commits", "mean_complexity",
        *[F.coalesce(name, zero).alias(name) for name in ("over_15", "over_20", "newest_files")])


def codebase_metrics(commits: DataFrame, trends: DataFrame, head_files: DataFrame | None,
                     as_of: Column | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Files, commits, mean complexity, debt ratio and quality per repository.

    ``totals``: the result of ``repo_totals`` where it is at hand already.
    """
    rows = repo_totals(commits, trends) if totals is None else totals
    if head_files is None:
        rows = rows.withColumn("_files", F.col("newest_files"))
    else:
        listed = head_files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_listed"))
        rows = (rows.join(listed, "repo_id", "left")
                .withColumn("_files", F.coalesce("_listed", "newest_files")))
    mean = F.coalesce("mean_complexity", F.lit(0.0))
    debt = F.coalesce(F.try_divide("over_15", "_files"), F.lit(0.0))
    quality = F.greatest(F.lit(0.0), 100 - debt * 50 - mean * 2)
    return rows.select(
        "repo_id", F.col("_files").alias("total_files"), "total_commits",
        N.py_round(mean, 2).alias("average_complexity"),
        N.py_round(debt, 3).alias("technical_debt_ratio"),
        N.py_round(quality, 1).alias("code_quality_score"),
        (F.current_timestamp() if as_of is None else as_of).alias("last_analyzed"))


def average_files_per_commit(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Touches per commit, commits without files included."""
    touches = file_changes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_touches"))
    return (commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_commits"))
            .join(touches, "repo_id", "left")
            .select("repo_id", (F.coalesce("_touches", F.lit(0)) / F.col("_commits")).alias("average_files_per_commit")))


def commits_per_day(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id", F.to_date("committed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("commits"))


def resource_forecast(commits: DataFrame) -> DataFrame:
    """Velocity, review and testing needs from the last 7 active days and the 7 before."""
    newest = W.partitionBy("repo_id").orderBy(F.desc("day"))
    recent = commits_per_day(commits).withColumn("rn", F.row_number().over(newest)).filter("rn <= 14")
    base = recent.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(F.when(F.col("rn") <= 7, F.col("commits")).otherwise(0)).alias("last"),
        F.sum(F.when(F.col("rn") > 7, F.col("commits")).otherwise(0)).alias("before"))
    growth = N.guarded_ratio(F.col("last") - F.col("before"), F.col("before"))
    v = F.col("velocity")

    def row(kind, need, confidence):
        return F.struct(F.lit(kind).alias("resource_type"), need.alias("predicted_need"),
                        confidence.alias("confidence_score"), F.lit("7_days").alias("timeframe"))

    full = F.array(
        row("development_velocity", N.whole_at_least_one(v), N.clamp(1 - F.abs("growth"), 0.1, 0.9)),
        row("code_review_capacity", N.whole_at_least_one(v * 0.3), F.lit(0.7)),
        row("testing_effort", N.whole_at_least_one(v * 0.5), F.lit(0.6)))
    short = F.array(row("development_velocity", F.lit(10).cast("long"), F.lit(0.5)))
    return (base.withColumn("growth", growth)
            .withColumn("velocity", F.col("last") * (1 + F.col("growth")))
            .select("repo_id", F.inline(F.when(F.col("days") < 7, short).otherwise(full))))


def maintenance_forecast(totals: DataFrame) -> DataFrame:
    """Expected fixes, refactorings and documentation updates, from ``repo_totals``."""
    n = F.col("total_commits")
    ratio = F.coalesce(F.try_divide("maintenance_commits", n), F.lit(0.1))

    def row(kind, need, confidence):
        return F.struct(F.lit(kind).alias("maintenance_type"),
                        N.whole_at_least_one(need).alias("predicted_frequency"),
                        F.lit("30_days").alias("timeframe"), F.lit(confidence).alias("confidence_score"))

    return totals.select("repo_id", F.inline(F.array(
        row("bug_fixes", n * ratio * 0.1, 0.7),
        row("refactoring", F.col("over_20") * 0.2, 0.6),
        row("documentation", n * 0.05, 0.8))))


def complexity_forecast(totals: DataFrame) -> DataFrame:
    """One stable ``overall`` row: the mean complexity, or 10 without files."""
    return totals.select(
        "repo_id", F.lit("overall").alias("component"),
        N.py_round(F.coalesce("mean_complexity", F.lit(10.0)), 2).alias("predicted_complexity"),
        F.lit("stable").alias("trend"), F.lit(0.6).alias("confidence_score"))


def weekly_complexity_forecast(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Forecast from weekly means: the last week against the first, projected by 5 percent."""
    weeks = (file_changes.filter(F.col("complexity_after").isNotNull())
             .select(*COMMIT, "complexity_after")
             .join(commits.select(*COMMIT, sunday_week(F.col("committed_at")).alias("week")), COMMIT)
             .groupBy("repo_id", "week").agg(F.avg("complexity_after").alias("mean")))
    ends = weeks.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("weeks"), F.max_by("mean", "week").alias("last"),
        F.min_by("mean", "week").alias("first"))
    several = F.col("weeks") >= 2
    return ends.select(
        "repo_id", F.lit("overall").alias("component"),
        N.py_round(F.when(several, F.col("last") * 1.05).otherwise(F.col("last")), 2).alias("predicted_complexity"),
        F.when(several & (F.col("last") > F.col("first")), F.lit("increasing"))
        .otherwise(F.lit("stable")).alias("trend"),
        F.lit(0.6).alias("confidence_score"))
