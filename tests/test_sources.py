"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from codestrata.operators import history as H
from codestrata.plans.dashboard import dashboard, insights_document
from codestrata.session import shared_folder
from codestrata.sources import exports as S, sinks
from codestrata.sources.schemas import COMMITS, conform
from codestrata.sources.synthetic import synthetic_changes
from codestrata.streaming import rolling
from tests.conftest import plan_of, rows

DUMP = (
    "\x1ec3\x1fc2 cx\x1f1704326400\x1fAnn B\x1fann@x\x1fMerge work\n\nbody line\n\x1d\n"
    "\x1ec2\x1fc1\x1f1704240000\x1fBob\x1fbob@x\x1fAdd logo\n\x1d\n3\t1\tsrc/müll name.py\n-\t-\tlogo.png\n"
    "\x1ec1\x1f\x1f1704153600\x1fAnn B\x1fann@x\x1fStart\n\x1d\n10\t0\ta.py\n")


@pytest.fixture
def dump(tmp_path):
    for repo in ("one", "two"):
        (tmp_path / f"{repo}.log").write_text(DUMP, encoding="utf-8")
    return str(tmp_path)


def test_commits(spark, dump):
    df = S.load_commits(spark, dump)
    assert df.schema == COMMITS or [f.name for f in df.schema] == COMMITS.names
    one = {r["commit_hash"]: r for r in df.filter("repo_id = 'one'").collect()}
    assert set(one) == {"c1", "c2", "c3"} and df.count() == 6
    assert one["c3"]["parent_hash"] == "c2" and one["c1"]["parent_hash"] is None
    assert one["c3"]["message"] == "Merge work\n\nbody line\n" and one["c3"]["author"] == "Ann B <ann@x>"
    assert one["c1"]["committed_at"].isoformat().startswith("2024-01-02")


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "web.log").write_text(DUMP, encoding="utf-8")
    assert {r["repo_id"] for r in S.load_commits(spark, str(tmp_path)).collect()} == {"a/web", "b/web"}


def test_file_changes(spark, dump):
    df = S.load_file_changes(spark, dump).filter("repo_id = 'two'")
    assert rows(df, "commit_hash", "file_path", "insertions", "deletions", "lines") == [
        ("c1", "a.py", 10, 0, 10), ("c2", "logo.png", 0, 0, 0), ("c2", "src/müll name.py", 3, 1, 4)]


def test_history_from_a_dump(spark, dump):
    c, f = S.load_commits(spark, dump), S.load_file_changes(spark, dump)
    stats = {r["commit_hash"]: r["files"] for r in H.commit_statistics(c, f).filter("repo_id = 'one'").collect()}
    assert stats["c3"] == [] and stats["c2"] == ["logo.png", "src/müll name.py"]


def test_head_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a.py\nsrc/b.py\n")
    assert rows(S.load_head_files(spark, str(tmp_path))) == [("one", "a.py"), ("one", "src/b.py")]


def test_source_tree(spark, tmp_path):
    (tmp_path / "one" / "pkg").mkdir(parents=True)
    (tmp_path / "one" / "pkg" / "m.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "one" / "note.txt").write_text("no")
    assert rows(S.load_source_files(spark, str(tmp_path))) == [("one", "pkg/m.py", "x = 1\ny = 2\n")]


def test_source_tree_with_odd_names(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b" / "o+ne" / "pk g"
    folder.mkdir(parents=True)
    (folder / "mü +%20.py").write_text("x")
    expected = [("o+ne", "pk g/mü +%20.py", "x")]
    assert rows(S.load_source_files(spark, f"{tmp_path}/a b/")) == expected
    assert rows(S.load_source_files(spark, f"file://{tmp_path}/a b")) == expected
    (tmp_path / "a b" / "re po.x.txt").write_text("f.py")
    assert rows(S.load_head_files(spark, f"{tmp_path}/a b/re po.x.txt")) == [("re po.x", "f.py")]


def test_blob_at(spark):
    c = spark.createDataFrame([("r", h, None) for h in "abc"], "repo_id string, commit_hash string, committed_at timestamp")
    b = spark.createDataFrame([("r", "a", "p", "s", "1"), ("r", "b", "q", "s", "2"), ("r", "c", "p", "s", None)],
                              "repo_id string, commit_hash string, file_path string, content_sha string, content string")
    assert rows(S.blob_at(c, b, "p"), "commit_hash", "content") == [("a", "1")]


def test_insights_sink(spark, dump, tmp_path):
    c, f = S.load_commits(spark, dump), S.load_file_changes(spark, dump)
    docs = insights_document(dashboard(c, f, as_of=F.lit("2024-06-01").cast("timestamp")))
    out = str(tmp_path / "insights")
    sinks.write_insights(docs, out)
    back = spark.read.json(out)
    assert rows(back.select("repo_id", "metrics.total_commits")) == [("one", 3), ("two", 3)]
    text = sinks.pretty_json(docs).filter("repo_id = 'one'").collect()[0]["document"]
    parsed = json.loads(text)
    assert parsed["dashboard"]["generated_at"] == "2024-06-01T00:00:00" and "\n  \"dashboard\"" in text
    assert parsed["predictions"]["complexity"][0]["component"] == "overall"


def test_conform(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("commit_hash"), F.lit("r").alias("repo_id"))
    with pytest.raises(ValueError):
        conform(df, COMMITS)


def test_bucketed_tables_join_without_exchange(spark, data, tmp_path):
    from codestrata.plans import workload as X
    spark.sql("CREATE DATABASE IF NOT EXISTS buckets LOCATION '%s'" % tmp_path)
    sinks.write_bucketed(X.file_changes(spark, data), "buckets.changes", buckets=4)
    sinks.write_bucketed(X.commits(spark, data), "buckets.commits", buckets=4)
    c, f = spark.table("buckets.commits"), spark.table("buckets.changes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        delta = H.complexity_delta(c, f)
        assert "Exchange" not in plan_of(delta)
        impact = H.touch_impact(c, f)
        assert "Exchange" not in plan_of(impact) and impact.count() == f.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        spark.sql("DROP DATABASE buckets CASCADE")


def test_synthetic_rows(spark):
    df = synthetic_changes(spark, 4000)
    means = df.agg(F.avg("lines_changed"), F.avg("insertions"), F.avg("deletions"), F.avg("commit_frequency"),
                   F.min("author_count"), F.max("author_count")).collect()[0]
    assert all(abs(m - want) < 0.2 for m, want in zip(means[:4], (5, 3, 2, 2)))
    assert means[4:] == (1, 5) and rows(df) == rows(synthetic_changes(spark, 4000))


class _Session:
    """Stands in for a session with the given setting on the given master."""

    def __init__(self, setting, master, known=None):
        option = type("Option", (), {"isDefined": lambda _: known is not None, "get": lambda _: known})()
        context = type("Context", (), {"getCheckpointDir": lambda _: option})()
        self.conf = type("Conf", (), {"get": lambda _, key, default: setting})()
        self.sparkContext = type("Py", (), {"master": master, "_jsc": type("J", (), {"sc": lambda _: context})()})()


def test_shared_folder_follows_the_setting(spark):
    assert shared_folder(_Session("hdfs:///shared", "yarn")) == "hdfs:///shared"
    assert shared_folder(_Session(None, "yarn", "hdfs:///known")) == "hdfs:///known"
    with pytest.raises(RuntimeError):
        shared_folder(_Session(None, "yarn"))
    assert shared_folder(spark)


def _touch_stream(spark, folder):
    schema = "repo_id string, file_path string, committed_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _touches(spark, items):
    return spark.createDataFrame(items, "repo_id string, file_path string, t string").select(
        "repo_id", "file_path", F.to_timestamp("t").alias("committed_at"))


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch = _touches(spark, [("r", f"f{i % 3}", f"2024-01-{1 + i % 20:02} 05:00:00") for i in range(60)])
    batch.repartition(3).write.parquet(folder)
    rolling.close(batch, "2024-03-01 00:00:00").write.mode("append").parquet(folder)
    drained = rolling.drain(rolling.rolling_hotspots(_touch_stream(spark, folder), "7 days", "1 day", "25 days"),
                            str(tmp_path / "out"))
    assert rows(drained) == rows(rolling.rolling_hotspots(batch, "7 days", "1 day"))
    daily = rolling.drain(rolling.daily_velocity(_touch_stream(spark, folder), "25 days"))
    assert rows(daily) == rows(rolling.daily_velocity(batch))


def test_empty_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    _touches(spark, []).write.parquet(folder)
    assert rolling.drain(rolling.daily_velocity(_touch_stream(spark, folder))).isEmpty()


def test_drain_goes_on_where_it_stopped(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _touches(spark, [("r", "f", "2024-01-01 01:00:00")]).write.parquet(folder)
    run = lambda: rows(rolling.drain(rolling.daily_velocity(_touch_stream(spark, folder)), out), "commits")
    assert run() == []  # the day is still open
    _touches(spark, [("r", "f", "2024-01-01 02:00:00")]).write.mode("append").parquet(folder)
    assert run() == []
    _touches(spark, [("r", "f", "2024-01-05 02:00:00")]).write.mode("append").parquet(folder)
    assert run() == [(2,)]
    _touches(spark, [("r", "f", "2024-01-01 03:00:00")]).write.mode("append").parquet(folder)  # too late
    _touches(spark, [("r", "f", "2024-01-09 03:00:00")]).write.mode("append").parquet(folder)
    assert run() == [(1,), (2,)]


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "table")
    _touches(spark, []).write.parquet(folder)
    stream = rolling.daily_velocity(_touch_stream(spark, folder), watermark="1 day")
    for items in ([("r", "f", "2024-01-01 01:00:00")], [("r", "f", "2024-01-10 01:00:00")],
                  [("r", "f", "2024-01-01 02:00:00")], [("r", "f", "2024-01-20 01:00:00")]):
        _touches(spark, items).write.mode("append").parquet(folder)
        query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
                 .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start())
        query.awaitTermination()
    got = {str(r["day"]): r["commits"] for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01"] == 1 and got["2024-01-10"] == 1
