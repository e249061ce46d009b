"""Hand fixtures for history and insights."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codestrata.operators import history as H, insights as I
from codestrata.plans.dashboard import dashboard, insights_document
from codestrata.sources.schemas import COMMITS, FILE_CHANGES
from tests.conftest import rows

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def commits(spark, items):
    """Items: (hash, day, author, message[, parent])."""
    return spark.createDataFrame([
        ("r", h, p[0] if p else None, DAY + dt.timedelta(days=d), a, f"{a}@x", f"{a} <{a}@x>", m)
        for h, d, a, m, *p in items], COMMITS)


def changes(spark, items):
    """Items: (hash, path, insertions, deletions, before, after)."""
    return spark.createDataFrame([("r", h, p, i, d, i + d, b, a) for h, p, i, d, b, a in items], FILE_CHANGES)


def test_range_ends_are_included(spark):
    c = commits(spark, [("a", 0, "x", "m"), ("b", 1, "x", "m"), ("c", 2, "x", "m")])
    kept = H.commit_history(c, None, "2024-01-01", "2024-01-02")
    assert rows(kept, "commit_hash") == [("a",), ("b",)]


def test_root_commit(spark):
    c = commits(spark, [("a", 0, "x", "m"), ("b", 1, "y", "m", "a")])
    f = changes(spark, [("a", "p", 1, 1, 2.0, 9.0), ("b", "p", 1, 1, 9.0, 4.0)])
    assert rows(H.complexity_delta(c, f), "commit_hash", "complexity_delta") == [("a", 0.0), ("b", -5.0)]
    assert rows(H.with_parent(c), "commit_hash", "parent_author") == [("a", None), ("b", "x <x@x>")]


def test_added_and_deleted_files(spark):
    f = changes(spark, [("a", "new", 5, 0, None, 1.0), ("a", "old", 0, 5, 1.0, None), ("a", "same", 5, 5, 1.0, 1.0)])
    assert rows(H.change_metrics(f), "file_path") == [("same",)]
    assert rows(H.change_metrics(f, modified_only=False), "file_path", "change_type") == [
        ("new", "addition"), ("old", "deletion"), ("same", "refactor")]


@pytest.mark.parametrize("pick,expected", [("oldest", 30.0), ("newest", 5.0)])
def test_trend_picks_a_version(spark, pick, expected):
    c = commits(spark, [("a", 0, "x", "m"), ("b", 1, "x", "m"), ("c", 2, "x", "m"), ("d", 3, "x", "m")])
    f = changes(spark, [("a", "p", 1, 1, 0.0, 30.0), ("b", "p", 1, 1, 0.0, 10.0), ("c", "p", 1, 1, 0.0, 5.0),
                        ("d", "p", 1, 1, 0.0, None), ("d", "q", 1, 1, 0.0, None)])
    got = rows(H.complexity_trends(c, f, pick=pick), "file_path", "complexity", "change_frequency", "first_seen")
    assert got == [("p", expected, 4, 1), ("q", 0.0, 1, 1)]


def test_window_keeps_the_newest_commits(spark):
    c = commits(spark, [(f"{i:03}", i // 2, "x", "m") for i in range(300)])
    f = changes(spark, [(f"{i:03}", "p", 1, 1, 0.0, float(i)) for i in range(300)])
    assert rows(H.complexity_trends(c, f), "change_frequency", "complexity") == [(200, 100.0)]


def test_wide_commit_keeps_its_shape(spark):
    c = commits(spark, [("wide", 0, "x", "Refactor: move module"), ("thin", 1, "x", "Refactor: move module")])
    f = changes(spark, [("wide", f"p{i:05}", 1, 1, 0.0, 1.0) for i in range(25_000)] +
                [("thin", f"p{i}", 1, 1, 0.0, 1.0) for i in range(3)])
    for found in (H.commit_statistics(c, f), H.refactoring_patterns(c, f).filter("commit_hash is not null")):
        assert rows(found.select("commit_hash", F.size("files").alias("n"))) == [("thin", 3), ("wide", 25_000)]
    line = H.timeline(c, f)
    assert rows(line.select("commit_hash", F.size("changes").alias("n"))) == [("thin", 3), ("wide", 25_000)]


def test_limits_cut_the_touches_first(spark):
    c = commits(spark, [(f"{i:03}", i, "x", "m") for i in range(40)])
    f = changes(spark, [(f"{i:03}", f"a/p{i % 7}", 1, 1, 0.0, float(i)) for i in range(40)])
    all_rows = {r["commit_hash"]: r["changes"] for r in H.timeline(c, f).collect()}
    start = c.agg(F.max("committed_at")).first()[0]
    kept = H.timeline(c, f, start=str(start)).collect()
    assert len(kept) == 1 and kept[0]["changes"] == all_rows[kept[0]["commit_hash"]]
    assert H.timeline_rows(c, f, start=str(start)).count() == 1


def test_healthy_subsystem(spark):
    c = commits(spark, [(f"{i:03}", i % 50, "x", "work") for i in range(160)])
    f = changes(spark, [(f"{i:03}", "core/a.py", 1, 1, 0.0, 1.0) for i in range(160)])
    health = I.subsystem_health(I.subsystem_rollup(c, f))
    assert rows(health, "name", "status", "complexity_trend") == [("core", "healthy", "stable")]


def test_trend_reads_oldest_as_recent(spark):
    c = commits(spark, [("a", 0, "x", "m"), ("b", 1, "x", "m")])
    f = changes(spark, [("a", f"s/{i}", 1, 1, 0.0, 1.0) for i in range(5)] + [("b", "s/0", 1, 1, 0.0, 1.0)])
    rollup = I.subsystem_rollup(c, f)
    assert rows(I.subsystem_health(rollup), "complexity_trend") == [("increasing",)]
    assert rows(I.subsystem_health(rollup, chronology="corrected"), "complexity_trend") == [("decreasing",)]


def test_small_subsystems_are_dropped(spark):
    c = commits(spark, [(str(i), i, "x", "m") for i in range(4)])
    f = changes(spark, [(str(i), "s/a", 1, 1, 0.0, 1.0) for i in range(4)])
    assert I.subsystem_rollup(c, f).isEmpty()


def test_resource_forecast_short_history(spark):
    c = commits(spark, [(str(i), i, "x", "m") for i in range(6)])
    assert rows(I.resource_forecast(c), "resource_type", "predicted_need", "confidence_score") == [
        ("development_velocity", 10, 0.5)]


def test_resource_forecast_uses_active_days(spark):
    days = list(range(0, 28, 2))  # 14 active days with gaps
    items = [(f"{d}-{i}", d, "x", "m") for n, d in enumerate(days) for i in range(1 if n < 7 else 2)]
    got = rows(I.resource_forecast(commits(spark, items)), "resource_type", "predicted_need", "confidence_score")
    assert got == [("code_review_capacity", 8, 0.7), ("development_velocity", 28, 0.1), ("testing_effort", 14, 0.6)]


def test_patterns_keep_empty_keys(spark):
    c = commits(spark, [("a", 0, "x", "refactor: rename"), ("b", 0, "x", "refactor"), ("c", 0, "x", "rename")])
    f = changes(spark, [("a", "p", 1, 1, 0.0, 1.0), ("a", "o", 1, 1, 0.0, 1.0)])
    got = {r["pattern"]: (r["commit_hash"], r["files"]) for r in H.refactoring_patterns(c, f).collect()}
    assert got == {"rename": ("a", ["o", "p"]), "extract_method": (None, None), "move": (None, None), "inline": (None, None)}


def test_commit_without_files(spark):
    c, f = commits(spark, [("a", 0, "x", "m")]), changes(spark, [])
    assert rows(H.commit_statistics(c, f), "commit_hash", "files", "timestamp") == [("a", [], 1704067200)]


def test_empty_repository(spark):
    c, f = commits(spark, []), changes(spark, [])
    trends = H.complexity_trends(c, f)
    assert trends.isEmpty() and I.resource_forecast(c).isEmpty() and dashboard(c, f).isEmpty()


def test_commits_without_readable_files(spark):
    c, f = commits(spark, [("a", 0, "x", "m")]), changes(spark, [])
    m = I.codebase_metrics(c, H.complexity_trends(c, f), None).collect()[0]
    assert (m["total_files"], m["total_commits"], m["technical_debt_ratio"], m["code_quality_score"]) == (0, 1, 0.0, 100.0)
    totals = I.repo_totals(c, H.complexity_trends(c, f))
    assert rows(I.complexity_forecast(totals), "predicted_complexity", "trend") == [(10.0, "stable")]
    assert [r["predicted_frequency"] for r in I.maintenance_forecast(totals).collect()] == [1, 1, 1]


def test_model_scores_replace_the_rule(spark):
    c = commits(spark, [("a", 0, "x", "m")])
    f = changes(spark, [("a", "p", 1, 1, 0.0, 1.0)])
    trends = H.complexity_trends(c, f)
    assert I.refactor_alerts(trends).isEmpty()
    scores = spark.createDataFrame([("r", "p", 0.95)], "repo_id string, file_path string, score double")
    assert rows(I.refactor_alerts(trends, scores), "file_path", "severity") == [("p", "high")]


def test_dashboard_document(spark):
    c = commits(spark, [(f"{i}", i, "x", "fix") for i in range(20)])
    f = changes(spark, [(f"{i}", "core/a.py", 9, 9, 1.0, 40.0) for i in range(20)])
    stamp = F.lit("2024-06-01").cast("timestamp")
    row = insights_document(dashboard(c, f, as_of=stamp)).collect()[0]
    assert row["dashboard"]["refactor_alerts"][0]["severity"] == "high"
    assert row["metrics"]["total_commits"] == 20 and row["metrics"]["total_files"] == 1
    assert [p["maintenance_type"] for p in row["predictions"]["maintenance"]] == ["bug_fixes", "documentation", "refactoring"]
    assert row["subsystem_health"][0]["name"] == "core"


def test_parents_by_time(spark):
    c = commits(spark, [("b", 0, "x", "m"), ("a", 0, "x", "m"), ("c", 3, "x", "m"), ("d", 3, "x", "m"), ("e", 9, "x", "m")])
    got = rows(H.chronological_parents(c), "commit_hash", "parent_hash")
    assert got == [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")]


def test_weekly_forecast(spark):
    c = commits(spark, [("a", 0, "x", "m"), ("b", 10, "x", "m")])
    f = changes(spark, [("a", "p", 1, 1, 0.0, 10.0), ("b", "p", 1, 1, 0.0, 20.0)])
    assert rows(I.weekly_complexity_forecast(c, f), "predicted_complexity", "trend") == [(21.0, "increasing")]
