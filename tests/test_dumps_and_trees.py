"""Dumps as a data source, listings and trees."""

import io

import pytest
from pyspark.sql import functions as F

from codestrata.session import cut_lineage
from codestrata.sources import dumps, exports, trees
from tests.conftest import rows
from tests.test_sources import DUMP, dump  # noqa: F401


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
@pytest.mark.parametrize("chunk", [3, 64, 1 << 20])
def test_every_record_belongs_to_one_range(size, chunk, monkeypatch):
    monkeypatch.setattr(dumps, "CHUNK", chunk)
    data = ("junk before the first\n" + DUMP * 3).encode()
    found = [r for part in dumps.ranges({"x": (0, len(data))}, size) for r in dumps.records(io.BytesIO(data), part)]
    assert found == data.split(b"\x1e")[1:]


def test_the_source_reads_what_the_text_reader_reads(spark, dump):  # noqa: F811
    read = dumps.read_dumps(spark, dump, 60)
    assert read.rdd.getNumPartitions() > 4
    commits = exports.load_commits(spark, dump)
    assert rows(dumps.commits_of(read), *commits.columns) == rows(commits)
    changes = exports.load_file_changes(spark, dump)
    assert rows(dumps.changes_of(read), *changes.columns) == rows(changes)


def test_an_empty_folder_and_broken_records(spark, tmp_path):
    assert dumps.read_dumps(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.log").write_bytes(b"\x1eno fields\x1d\n\x1eh\x1f\x1fnever\x1fa\x1fe\x1fm\xff\x1d\nx\t1\tp\n1\t2\tq\tr\n")
    (tmp_path / "_hidden").write_text(DUMP)
    row, = dumps.read_dumps(spark, str(tmp_path)).collect()
    assert (row["repo_id"], row["committed_at"], row["parent_hash"]) == ("bad", None, None)
    assert [tuple(f) for f in row["files"]] == [("q\tr", 1, 2)]


def test_the_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, log = (tmp_path / n for n in ("in", "out", "log"))
    folder.mkdir()
    def drain():
        stream = dumps.commits_of(dumps.read_dumps(spark, str(folder), 50, stream=True))
        (stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log))
         .trigger(availableNow=True).start().awaitTermination())
        return sorted((r["repo_id"], r["commit_hash"]) for r in spark.read.schema(stream.schema).parquet(str(out)).collect())

    parts = ["\x1e" + p for p in DUMP.split("\x1e")[1:]]
    (folder / "one.log").write_text(parts[0])
    assert drain() == [("one", "c3")]
    with open(folder / "one.log", "a") as f:
        f.write(parts[1] + parts[2])
    (folder / "two.log").write_text(parts[2])
    assert drain() == [("one", "c1"), ("one", "c2"), ("one", "c3"), ("two", "c1")]
    assert len(drain()) == 4


def test_written_dumps_come_back(spark, tmp_path):
    commits = spark.createDataFrame(
        [("a b", "c1", None, 10, "Ann", "a@x", "one\n\nbody"), ("a b", "c2", "c1", 20, "Bob", "b@x", ""), ("z", "c1", None, 5, "A", "e", "m")],
        "repo_id string, commit_hash string, parent_hash string, t long, author_name string, author_email string, message string")
    commits = commits.withColumn("committed_at", F.timestamp_seconds("t")).drop("t")
    changes = spark.createDataFrame([("a b", "c2", "x y/ü.py", 1, 2), ("a b", "c2", "b.py", 0, 3)],
                                    "repo_id string, commit_hash string, file_path string, insertions long, deletions long")
    dumps.write_dumps(commits, changes, str(tmp_path / "d"))
    back = dumps.read_dumps(spark, str(tmp_path / "d"), 20)
    assert rows(dumps.commits_of(back), *commits.columns) == rows(commits)
    assert rows(dumps.changes_of(back), *changes.columns) == rows(changes)


def test_a_tree_is_scanned_and_known_files_stay_closed(spark, tmp_path):
    root = tmp_path / "t"
    (root / "one" / "deep" / "er").mkdir(parents=True)
    (root / "two" / ".git").mkdir(parents=True)
    (root / "one" / "deep" / "er" / "a b.py").write_text("x = 1\n")
    (root / "one" / "n.txt").write_text("no")
    (root / "two" / "m.py").write_bytes(b"\xff")
    (root / "two" / ".git" / "h.py").write_text("hidden")
    first = cut_lineage(trees.scan_tree(spark, str(root)))
    assert rows(first, "repo_id", "file_path", "content", "read") == [
        ("one", "deep/er/a b.py", "x = 1\n", True), ("two", "m.py", "�", True)]
    (root / "two" / "m.py").write_text("changed")
    (root / "two" / "new.py").write_text("")
    again = trees.scan_tree(spark, str(root), first.drop("content"))
    assert rows(again, "file_path", "content", "read") == [
        ("deep/er/a b.py", None, False), ("m.py", "changed", True), ("new.py", "", True)]
    assert {r["content_sha"] for r in first.collect()} & {r["content_sha"] for r in again.collect()}
    assert trees.scan_tree(spark, str(tmp_path / "missing")).count() == 0


def test_tree_listings(spark, tmp_path):
    files = spark.createDataFrame([("r", "a\tb.py", "h1"), ("r", "c.py", "h2"), ("s", "c.py", "h2")],
                                  "repo_id string, file_path string, content_sha string")
    trees.write_tree_listing(files, str(tmp_path / "l"))
    (tmp_path / "l" / "repo_id=r" / "more.txt").write_text("160000 commit h9\tsub\nnoise\n")
    assert rows(trees.load_tree_listing(spark, str(tmp_path / "l")), *files.columns) == rows(files)


def test_small_ranges_are_dealt_to_few_tasks():
    spans = {"a": (0, 10_000_000), "b": (5, 6), "c": (100, 3_000_123)}
    found = dumps.shares(spans, 1000, 40)
    assert len(found) <= 2 * 40 and sum(len(s.spans) for s in found) <= 2 * 40 + len(spans)
    assert [r for s in found for r in s.ranges()] == dumps.ranges(spans, 1000)
    # Ranges as large as a task's part stay alone, and no task takes more than the bytes of a partition.
    assert len(dumps.shares({"a": (0, 20), "b": (0, 20)}, 64, 4)) == 2
    large = dumps.shares({"a": (0, 1 << 40)}, 1 << 20, 4)
    assert max(p.end - p.start for s in large for p in s.spans) == dumps.PART_BYTES


def test_a_range_reads_little_beyond_its_end():
    data, read = (("\x1e" + "x" * 99) * 100_000).encode(), []

    class Counted(io.BytesIO):
        def read(self, n):
            read.append(n)
            return super().read(n)

    assert len(list(dumps.records(Counted(data), dumps.Range("x", 0, 16_000, len(data))))) == 160
    assert sum(read) <= 16_000 + dumps.STEP
    assert [len(r) for r in dumps.records(io.BytesIO(b"\x1e" + b"y" * 100_000 + b"\x1ez"), dumps.Range("x", 0, 5, 100_003))] == [100_000]


def test_a_task_reads_ranges_of_several_dumps(spark, tmp_path):
    for name in ("one", "two", "three"):
        (tmp_path / f"{name}.log").write_text(DUMP)
    read = dumps.read_dumps(spark, str(tmp_path), 7)
    assert 4 < read.rdd.getNumPartitions() <= 2 * 4 * spark.sparkContext.defaultParallelism
    commits = exports.load_commits(spark, str(tmp_path))
    assert rows(dumps.commits_of(read), *commits.columns) == rows(commits)
