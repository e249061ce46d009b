"""Commit-history operators."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from ..functions.dates import iso_timestamp
from ..functions.fixed_values import REFACTORING_KEYWORDS
from ..functions.numbers import change_impact, file_risk_score
from ..functions.paths import under_path
from .grouping import key_filter, nested, newest_commits, skew_join

COMMIT = ["repo_id", "commit_hash"]
FILE = ["repo_id", "file_path"]


def in_range(ts: Column, start=None, end=None) -> Column:
    """Both ends included; an absent end is open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        keep = keep & (ts <= F.lit(end).cast("timestamp"))
    return keep


def commit_history(commits: DataFrame, file_changes: DataFrame | None = None,
                   start=None, end=None, path: str | None = None) -> DataFrame:
    """Commits in a date range that touch ``path`` or something below it."""
    kept = commits.filter(in_range(F.col("committed_at"), start, end))
    if path is None:
        return kept
    touching = file_changes.filter(under_path(F.col("file_path"), path)).select(*COMMIT)
    return kept.join(touching, COMMIT, "left_semi")


def with_parent(commits: DataFrame) -> DataFrame:
    """First parent's time and author beside each commit; nulls for a root commit."""
    parent = commits.select("repo_id", F.col("commit_hash").alias("parent_hash"),
                            F.col("committed_at").alias("parent_committed_at"),
                            F.col("author").alias("parent_author"))
    return commits.join(parent, ["repo_id", "parent_hash"], "left")


def chronological_parents(commits: DataFrame) -> DataFrame:
    """Fill ``parent_hash`` with the commit before, for exports that carry no parents.

    Inside a day the commits are ordered directly; the first of a day follows the last of the
    day before it. No task orders more than one day of one repository, or its list of days.
    """
    day = F.to_date("committed_at")
    inner = W.partitionBy("repo_id", "_day").orderBy("committed_at", "commit_hash")
    dated = commits.withColumn("_day", day).withColumn("_lag", F.lag("commit_hash").over(inner))
    last = dated.groupBy("repo_id", "_day").agg(
        F.max(F.struct("committed_at", "commit_hash"))["commit_hash"].alias("_last"))
    carried = last.select("repo_id", "_day", F.lag("_last").over(
        W.partitionBy("repo_id").orderBy("_day")).alias("_carry"))
    return (dated.join(carried, ["repo_id", "_day"])
            .withColumn("parent_hash", F.coalesce("_lag", "_carry"))
            .drop("_day", "_lag", "_carry"))


def attach_complexity(file_changes: DataFrame, commits: DataFrame, scored: DataFrame) -> DataFrame:
    """Complexity before (at the parent) and after (at the commit) from scored file versions.

    ``scored`` has one row per known file version: repo_id, commit_hash, file_path, complexity.
    """
    after = scored.select(*COMMIT, "file_path", F.col("complexity").alias("complexity_after"))
    before = scored.select("repo_id", F.col("commit_hash").alias("parent_hash"), "file_path",
                           F.col("complexity").alias("complexity_before"))
    return (file_changes.drop("complexity_before", "complexity_after")
            .join(after, [*COMMIT, "file_path"], "left")
            .join(commits.select(*COMMIT, "parent_hash"), COMMIT, "left")
            .join(before, ["repo_id", "parent_hash", "file_path"], "left")
            .drop("parent_hash"))


def _modified() -> Column:
    return F.col("complexity_before").isNotNull() & F.col("complexity_after").isNotNull()


def change_metrics(file_changes: DataFrame, modified_only: bool = True) -> DataFrame:
    """Lines, complexity before and after, and change type per touched file."""
    rows = file_changes.filter(_modified()) if modified_only else file_changes
    return rows.select(
        *COMMIT, "file_path", F.col("insertions").alias("lines_added"),
        F.col("deletions").alias("lines_deleted"), "complexity_before", "complexity_after",
        rules.change_type(F.col("insertions"), F.col("deletions"),
                          F.col("complexity_before").isNull(),
                          F.col("complexity_after").isNull()).alias("change_type"))


def touches_of(kept: DataFrame, file_changes: DataFrame, *limits) -> DataFrame:
    """The touches of the kept commits, cut down before anything is summed; all of them without a limit."""
    if all(x is None for x in limits):
        return file_changes
    return skew_join(file_changes, kept.select(*COMMIT), COMMIT, "left_semi")


def with_delta(commits: DataFrame, file_changes: DataFrame, count: str | None = None) -> DataFrame:
    """Commits with ``complexity_delta``: the sum of (after - before) over the modified files.

    A root commit has delta 0. ``count`` names a column for the number of modified files.
    """
    sums = (file_changes.filter(_modified()).groupBy(*COMMIT)
            .agg(F.sum(F.col("complexity_after") - F.col("complexity_before")).alias("_delta"),
                 F.count(F.lit(1)).alias("_files")))
    delta = F.when(F.col("parent_hash").isNull(), F.lit(0.0)).otherwise(F.coalesce("_delta", F.lit(0.0)))
    rows = commits.join(sums, COMMIT, "left").withColumn("complexity_delta", delta)
    if count is not None:
        rows = rows.withColumn(count, F.coalesce("_files", F.lit(0).cast("long")))
    return rows.drop("_delta", "_files")


def complexity_delta(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    return with_delta(commits.select(*COMMIT, "parent_hash"), file_changes).drop("parent_hash")


def refactoring_commits(commits: DataFrame, start=None, end=None) -> DataFrame:
    """Commits whose message names a refactoring, with its ``pattern``."""
    return (commits.filter(in_range(F.col("committed_at"), start, end)
                           & rules.mentions_refactor(F.col("message")))
            .withColumn("pattern", rules.refactoring_kind(F.col("message")))
            .filter(F.col("pattern").isNotNull()))


def refactoring_patterns(commits: DataFrame, file_changes: DataFrame, start=None, end=None) -> DataFrame:
    """One row per pattern and commit with its files; a pattern without commits keeps one empty row."""
    found = refactoring_commits(commits, start, end).select(
        *COMMIT, "pattern", "committed_at", "message")
    files = nested(file_changes.join(found.select(*COMMIT), COMMIT, "left_semi"),
                   COMMIT, F.col("file_path"), "files")
    rows = found.join(files, COMMIT, "left").withColumn(
        "files", F.coalesce("files", F.array().cast("array<string>")))
    names = F.explode(F.array(*[F.lit(name) for name, _ in REFACTORING_KEYWORDS])).alias("pattern")
    keys = commits.select("repo_id").distinct().select("repo_id", names)
    # The patterns a repository does use: a handful of rows, joined back to find the empty ones.
    used = found.groupBy("repo_id", "pattern").agg(F.count(F.lit(1)).alias("_n"))
    empty = keys.join(used, ["repo_id", "pattern"], "left_anti")
    return rows.unionByName(empty, allowMissingColumns=True)


def pattern_summary(commits: DataFrame, file_changes: DataFrame, impact: DataFrame) -> DataFrame:
    """Commits, affected files and summed impact per pattern. ``impact``: one row per touch."""
    found = refactoring_commits(commits).select(*COMMIT, "pattern")
    frequency = found.groupBy("repo_id", "pattern").agg(F.count(F.lit(1)).alias("frequency"))
    touched = (skew_join(impact, found, COMMIT)
               .groupBy("repo_id", "pattern", "file_path").agg(F.sum("impact").alias("_impact")))
    totals = touched.groupBy("repo_id", "pattern").agg(
        F.count(F.lit(1)).alias("n_affected_files"), F.sum("_impact").alias("impact_score"))
    return (frequency.join(totals, ["repo_id", "pattern"], "left")
            .withColumn("n_affected_files", F.coalesce("n_affected_files", F.lit(0).cast("long")))
            .withColumn("impact_score", F.coalesce("impact_score", F.lit(0.0))))


def pattern_files(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Distinct files per pattern, one row each: a pattern's files grow with the repository."""
    found = refactoring_commits(commits).select(*COMMIT, "pattern")
    return skew_join(file_changes, found, COMMIT).select("repo_id", "pattern", "file_path").distinct()


def touch_impact(commits: DataFrame, file_changes: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """Impact score of every touch: lines, commit-level complexity change, message importance."""
    per_commit = with_delta(commits.select(*COMMIT, "parent_hash", "committed_at"), file_changes).drop("parent_hash")
    if importance is None:
        per_commit = per_commit.withColumn("importance", F.lit(0.0))
    else:
        per_commit = (per_commit.join(importance.select(*COMMIT, "importance"), COMMIT, "left")
                      .withColumn("importance", F.coalesce("importance", F.lit(0.0))))
    touched = file_changes.select(*COMMIT, "file_path", "insertions", "deletions")
    return skew_join(touched, per_commit, COMMIT).withColumn("impact", change_impact(
        F.col("insertions"), F.col("deletions"), F.col("complexity_delta"), F.col("importance")))


# Units of a timeframe such as 1m or 2w.
TIMEFRAME_UNITS = {"d": "DAY", "w": "WEEK", "m": "MONTH", "y": "YEAR"}


def timeframe_start(timeframe: str, as_of) -> Column:
    """Time ``as_of`` minus a timeframe: a number and one of d, w, m, y."""
    number, unit = int(timeframe[:-1]), TIMEFRAME_UNITS[timeframe[-1]]
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {number} {unit}")


def hotspots(commits: DataFrame, file_changes: DataFrame, importance: DataFrame | None = None,
             timeframe: str | None = None, as_of=None) -> DataFrame:
    """Touches, summed impact and newest touch per file.

    Looks at all history, or at the ``timeframe`` that ends at ``as_of``.
    """
    kept = commits
    if timeframe is not None:
        when = F.col("committed_at")
        kept = kept.filter((when > timeframe_start(timeframe, as_of)) & (when <= F.lit(as_of).cast("timestamp")))
    impact = touch_impact(kept, touches_of(kept, file_changes, timeframe), importance)
    return impact.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("change_count"), F.sum("impact").alias("impact_score"),
        F.max("committed_at").alias("last_modified"))


def complexity_trend(commits: DataFrame, file_changes: DataFrame, path: str | None = None,
                     start=None, end=None) -> DataFrame:
    """Every readable version of one path, or of every path, in a date range, newest first."""
    versions = file_changes.filter(F.col("complexity_after").isNotNull())
    if path is not None:
        versions = versions.filter(F.col("file_path") == path)
    return (commits.filter(in_range(F.col("committed_at"), start, end))
            .select(*COMMIT, "committed_at").join(versions, COMMIT)
            .select(*FILE, F.col("committed_at").alias("timestamp"),
                    F.col("complexity_after").alias("complexity"), "commit_hash")
            .orderBy(*FILE, F.desc("timestamp"), F.desc("commit_hash")))


def commit_statistics(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Commit, POSIX seconds and its touched files; a commit without files has an empty array."""
    files = nested(file_changes, COMMIT, F.col("file_path"), "files")
    return (commits.join(files, COMMIT, "left")
            .select(*COMMIT, F.unix_timestamp("committed_at").alias("timestamp"), "author", "message",
                    F.coalesce("files", F.array().cast("array<string>")).alias("files")))


def files_per_commit(file_changes: DataFrame) -> DataFrame:
    return file_changes.groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("n_files"))


def repo_statistics(commits: DataFrame, trends: DataFrame, head_files: DataFrame | None) -> DataFrame:
    """Files at the newest state; without a listing, the files of the newest commit.

    The files of the newest commit are those that ``complexity_trends`` saw first.
    """
    newest = trends.groupBy("repo_id").agg(F.count_if(F.col("first_seen") == 1).alias("_newest"))
    last = (commits.select("repo_id").distinct().join(newest, "repo_id", "left")
            .select("repo_id", F.coalesce("_newest", F.lit(0).cast("long")).alias("_last")))
    if head_files is None:
        return last.select("repo_id", F.col("_last").alias("total_files"))
    listed = head_files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_listed"))
    return last.join(listed, "repo_id", "full").select(
        "repo_id", F.coalesce("_listed", "_last", F.lit(0).cast("long")).alias("total_files"))


def complexity_trends(commits: DataFrame, file_changes: DataFrame, max_commits: int = 200,
                      pick: str = "oldest") -> DataFrame:
    """Touches and complexity per file over the newest commits of each repository.

    ``pick`` chooses which readable version in the window gives the complexity.
    ``first_seen`` is the rank of the newest commit touching the file.

    The window holds ``max_commits`` rows per repository. Its commits filter the touches where they are
    read, so that touches outside the window are not exchanged, however the join itself is carried out.
    """
    recent = newest_commits(commits.select(*COMMIT, "committed_at"), max_commits).select(*COMMIT, "rn")
    touched = (file_changes.select(*COMMIT, "file_path", "complexity_after").filter(key_filter(recent, COMMIT))
               .join(recent, COMMIT))
    seen = F.when(F.col("complexity_after").isNotNull(), F.col("rn"))
    choose = F.max_by if pick == "oldest" else F.min_by
    return touched.groupBy(*FILE).agg(
        F.coalesce(choose("complexity_after", seen), F.lit(0.0)).alias("complexity"),
        F.count(F.lit(1)).alias("change_frequency"),
        F.min("rn").cast("long").alias("first_seen"))


def timeline(commits: DataFrame, file_changes: DataFrame, importance: DataFrame | None = None,
             start=None, end=None, path: str | None = None) -> DataFrame:
    """Commit with its nested changes, complexity delta and message importance."""
    kept = commit_history(commits, file_changes, start, end, path)
    touched = touches_of(kept, file_changes, start, end, path)
    changes = nested(change_metrics(touched), COMMIT, F.struct(
        "file_path", "lines_added", "lines_deleted", "complexity_before", "complexity_after",
        "change_type"), "changes")
    rows = with_delta(kept, touched).join(changes, COMMIT, "left")
    rows = (rows.withColumn("semantic_importance", F.lit(0.0)) if importance is None else
            rows.join(importance.select(*COMMIT, F.col("importance").alias("semantic_importance")),
                      COMMIT, "left").fillna(0.0, ["semantic_importance"]))
    empty = F.array().cast(changes.schema["changes"].dataType)
    return rows.select(
        "repo_id", F.col("committed_at").alias("timestamp"), "commit_hash", "author", "message",
        F.coalesce("changes", empty).alias("changes"), "complexity_delta", "semantic_importance")


def timeline_rows(commits: DataFrame, file_changes: DataFrame, start=None, end=None,
                  path: str | None = None) -> DataFrame:
    """The timeline as one row per change, without nesting."""
    kept = commit_history(commits, file_changes, start, end, path)
    touched = touches_of(kept, file_changes, start, end, path)
    facts = with_delta(kept.select(*COMMIT, "parent_hash", "committed_at", "author", "message"), touched,
                       count="_told").drop("parent_hash")
    # The changes lead, so that a commit with very many of them can be split.
    told = skew_join(change_metrics(touched), facts.drop("_told"), COMMIT)
    quiet = facts.filter(F.col("_told") == 0).drop("_told")
    return told.unionByName(quiet, allowMissingColumns=True)


def commit_analysis(timeline_df: DataFrame) -> DataFrame:
    """The timeline under its record name: the delta is called complexity impact."""
    return timeline_df.withColumnRenamed("complexity_delta", "complexity_impact")


def commit_frequency(file_changes: DataFrame) -> DataFrame:
    return file_changes.groupBy(*FILE).agg(F.count(F.lit(1)).alias("frequency"))


def last_modified(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Newest touching commit per file as ISO-8601 text."""
    return (file_changes.select(*COMMIT, "file_path")
            .join(commits.select(*COMMIT, "committed_at"), COMMIT)
            .groupBy(*FILE).agg(F.max("committed_at").alias("_ts"))
            .select(*FILE, iso_timestamp(F.col("_ts")).alias("last_modified")))


def hotspot_metrics(commits: DataFrame, file_changes: DataFrame, trends: DataFrame) -> DataFrame:
    """Per file: touches, newest touch, daily complexity, risk and contributors.

    The trend holds one mean per active day and every contributor appears once.
    """
    touched = file_changes.select(*COMMIT, "file_path", "complexity_after").join(
        commits.select(*COMMIT, "committed_at", "author"), COMMIT)
    totals = touched.groupBy(*FILE).agg(F.count(F.lit(1)).alias("change_frequency"),
                                        F.max("committed_at").alias("last_modified"))
    days = (touched.filter(F.col("complexity_after").isNotNull())
            .groupBy(*FILE, F.to_date("committed_at").alias("day"))
            .agg(F.avg("complexity_after").alias("complexity")))
    trend = days.groupBy(*FILE).agg(
        F.array_sort(F.collect_list(F.struct("day", "complexity"))).alias("_days"))
    people = nested(touched.select(*FILE, "author").distinct(), FILE, F.col("author"), "contributors")
    risk = trends.select(*FILE, file_risk_score(
        F.col("complexity"), F.col("change_frequency")).alias("risk_score"))
    return (totals.join(trend, FILE, "left").join(people, FILE).join(risk, FILE, "left")
            .select(*FILE, "change_frequency", "last_modified",
                    F.transform("_days", lambda d: d["complexity"]).alias("complexity_trend"),
                    F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), "contributors"))


class EvolutionInsights(NamedTuple):
    """Header per repository, and flat tables of what grows with it."""

    header: DataFrame
    hotspots: DataFrame
    patterns: DataFrame
    pattern_files: DataFrame


def evolution_insights(commits: DataFrame, file_changes: DataFrame, metrics: DataFrame, trends: DataFrame,
                       importance: DataFrame | None = None) -> EvolutionInsights:
    """Per repository: date span, commits, daily complexity and health; every hotspot and every pattern in full.

    The hotspots are those of ``hotspot_metrics``, the patterns those of ``pattern_summary`` with their
    files in ``pattern_files``: one row each, none left out.
    """
    span = commits.groupBy("repo_id").agg(
        F.min("committed_at").alias("start_date"), F.max("committed_at").alias("end_date"),
        F.count(F.lit(1)).alias("total_commits"))
    days = (file_changes.filter(F.col("complexity_after").isNotNull())
            .join(commits.select(*COMMIT, "committed_at"), COMMIT)
            .groupBy("repo_id", F.to_date("committed_at").alias("day"))
            .agg(F.avg("complexity_after").alias("complexity")))
    trend = days.groupBy("repo_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("day", "complexity"))),
        lambda d: d["complexity"]).alias("complexity_trend"))
    health = metrics.select("repo_id", F.col("code_quality_score").alias("health_score"))
    header = span.join(trend, "repo_id", "left").join(health, "repo_id", "left")
    return EvolutionInsights(
        header, hotspot_metrics(commits, file_changes, trends),
        pattern_summary(commits, file_changes, touch_impact(commits, file_changes, importance)),
        pattern_files(commits, file_changes))
