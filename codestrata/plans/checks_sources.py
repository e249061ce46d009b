"""Checked queries: exported histories, listings and trees, written and read back in full."""

import uuid

from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from ..sources import dumps, trees
from . import workload as X
from .registry import query, sql_time

TS = sql_time("committed_at")
#: Small enough that every dump is read in several partitions.
PART_BYTES = 16 << 10


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/sources-{uuid.uuid4().hex}"


def _dumps(spark, sf):
    folder = _folder(spark)
    dumps.write_dumps(X.commits(spark, sf, parents=True), X.file_changes(spark, sf), folder)
    return dumps.read_dumps(spark, folder, PART_BYTES)


@query("s1_history_dumps", f"""
SELECT repo_id, CAST(commit_hash AS VARCHAR) AS commit_hash, CAST(parent_hash AS VARCHAR) AS parent_hash,
       {TS} AS committed_at, author_name, author_email, author, message FROM commits""")
def _(spark, sf):
    return dumps.commits_of(_dumps(spark, sf))


@query("s2_dumped_changes", """
SELECT repo_id, CAST(commit_hash AS VARCHAR) AS commit_hash, file_path, insertions, deletions, lines FROM changes""")
def _(spark, sf):
    return dumps.changes_of(_dumps(spark, sf)).drop("complexity_before", "complexity_after")


@query("s2_streamed_changes", """
SELECT repo_id, CAST(commit_hash AS VARCHAR) AS commit_hash, file_path, insertions, deletions, lines FROM changes""")
def _(spark, sf):
    """The dumps as a stream, drained after each of two exports."""
    folder, target = _folder(spark), _folder(spark)
    commits, changes = X.commits(spark, sf, parents=True), X.file_changes(spark, sf)
    for half in (F.col("commit_hash") % 2 == 0, F.col("commit_hash") % 2 == 1):
        dumps.write_dumps(commits.filter(half), changes.filter(half), folder)
        rows = dumps.changes_of(dumps.read_dumps(spark, folder, PART_BYTES, stream=True)).drop("complexity_before", "complexity_after")
        (rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-log")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(rows.schema).parquet(target)


@query("s3_tree_listing", """
SELECT repo_id, file_path, sha256(content) AS content_sha FROM py_files""", use="python")
def _(spark, sf):
    folder = _folder(spark)
    files = X.python_files(spark, sf)
    trees.write_tree_listing(files.select("repo_id", "file_path", F.sha2("content", 256).alias("content_sha")), folder)
    return trees.load_tree_listing(spark, folder)


@query("s4_source_tree", """, n AS (
SELECT coalesce(lang, '') AS repo_id, 'src' || doc_id || '.py' AS file_path, doc_id % 5 = 0 AS changed,
       coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'pass' ELSE '' END AS content FROM documents)
SELECT repo_id, file_path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS content_sha, changed AS read,
       CASE WHEN changed THEN CAST(length(content) AS BIGINT) END AS n_chars FROM n""", use="lines")
def _(spark, sf):
    """A tree scanned twice: the second scan opens only the files that were written in between."""
    folder = _folder(spark)
    key = F.regexp_extract("file_path", r"src(-?\d+)", 1).cast("long")
    files = X.source_files(spark, sf).withColumn("repo_id", F.coalesce("repo_id", F.lit("")))
    trees.write_tree(files, folder).count()
    known = cut_lineage(trees.scan_tree(spark, folder).drop("content"))
    changed = files.filter(key % 5 == 0).withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit("\npass")))
    trees.write_tree(changed, folder).count()
    return trees.scan_tree(spark, folder, known).select(
        "repo_id", "file_path", "size", "content_sha", "read", F.length("content").alias("n_chars"))
