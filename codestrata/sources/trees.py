"""Source trees and their manifests: listed by tasks, read only where a content is not known yet."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.grouping import skew_join
from ..session import cut_lineage
from .folders import below, listed, open_folder

ENTRY = "path string, folder boolean, size bigint, modified bigint"
#: Bytes of file contents that one Arrow batch may hold beside its last file.
BATCH_BYTES = 16 << 20


def list_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """``path, size, modified`` of every file below ``root``, paths relative to it, times in nanoseconds.

    Each round lists the folders found by the one before, spread over ``tasks`` tasks, so the
    driver holds neither a folder nor a file; there are as many rounds as the tree is deep. Names that begin
    with a dot are left out; an empty or missing folder gives no rows.
    """
    spread = tasks or spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = [e for e in listed(system, f"{top}/{name}".rstrip("/")) if not e.base_name.startswith(".")]
                for at in range(0, len(found), 10_000):
                    part = found[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([below(top, e.path) for e in part], pa.string()),
                         pa.array([e.type == fs.FileType.Directory for e in part], pa.bool_()),
                         pa.array([e.size for e in part], pa.int64()),
                         pa.array([e.mtime_ns for e in part], pa.int64())], names=["path", "folder", "size", "modified"])

    files, level = None, spark.createDataFrame([("",)], "path string")
    while True:
        level = cut_lineage(level.repartition(spread).mapInArrow(run, ENTRY))
        here = level.filter("not folder").select("path", "size", "modified")
        files = here if files is None else files.unionByName(here)
        level = level.filter("folder").select("path")
        if level.isEmpty():
            return files


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``files`` with ``content_sha``, the SHA-256 of the bytes, and ``content``, the text (UTF-8, faults replaced).

    A file that is gone has nulls. Files are read one after the other, spread by path.
    """
    schema = files.withColumn("content_sha", F.lit("")).withColumn("content", F.lit("")).schema
    for f in schema.fields[-2:]:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(root)
        for batch in batches:
            start, held, size = 0, [], 0
            for n, path in enumerate(batch.column(batch.schema.get_field_index("path")).to_pylist()):
                try:
                    with system.open_input_stream(f"{top}/{path}") as stream:
                        data = stream.read()
                    held.append((hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")))
                    size += len(data)
                except FileNotFoundError:
                    held.append((None, None))
                if size >= BATCH_BYTES or n == batch.num_rows - 1:
                    columns = [c.slice(start, len(held)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.string()) for c in zip(*held)]],
                                                     names=[*batch.schema.names, "content_sha", "content"])
                    start, held, size = n + 1, [], 0

    return files.mapInArrow(run, schema)


def scan_tree(spark: SparkSession, root: str, known: DataFrame | None = None, pattern: str = r"\.py$") -> DataFrame:
    """``repo_id, file_path, path, size, modified, content_sha, content, read`` of the matching files below ``root``.

    The first folder names the repository. A file whose path, size and time stand in ``known`` (the manifest of
    an earlier scan) keeps the hash of that scan and is not opened: ``content`` is null and ``read`` false. The
    result without ``content`` is the next manifest. Files that were read carry their content; equal contents are told by hash.
    """
    files = list_tree(spark, root).filter(F.col("path").rlike(pattern))
    if known is None:
        fresh, kept = files, None
    else:
        seen = known.select("path", "size", "modified", "content_sha")
        marked = skew_join(files, seen, ["path", "size", "modified"], "left")
        kept = marked.filter("content_sha is not null").withColumn("content", F.lit(None).cast("string")).withColumn("read", F.lit(False))
        fresh = marked.filter("content_sha is null").drop("content_sha")
    rows = read_files(fresh.repartition(spark.sparkContext.defaultParallelism * 4, "path"), root).withColumn("read", F.lit(True))
    rows = rows if kept is None else rows.unionByName(kept)
    return rows.select(F.substring_index("path", "/", 1).alias("repo_id"),
                       F.regexp_replace("path", "^[^/]*/", "").alias("file_path"), "*")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write ``repo_id, file_path, content`` as files below ``root``; returns the written paths and sizes once asked for.

    Each file is written whole by the task that holds its row; a repeated task writes the same bytes again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(root)
        made: set[str] = set()
        for batch in batches:
            paths, sizes = [], []
            for repo, path, content in zip(*[c.to_pylist() for c in batch.columns]):
                full, data = f"{top}/{repo}/{path}", (content or "").encode()
                folder = full.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                with system.open_output_stream(full) as out:
                    out.write(data)
                paths.append(below(top, full))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("repo_id", "file_path", "content").mapInArrow(run, "path string, size bigint")


def load_tree_listing(spark: SparkSession, path: str) -> DataFrame:
    """``repo_id, file_path, content_sha`` of ``git ls-tree -r HEAD`` listings, one folder ``repo_id=...`` per repository.

    Entries that are no files (links to other repositories) are left out.
    """
    head, name = F.split(F.substring_index("value", "\t", 1), " "), F.regexp_replace("value", "^[^\t]*\t", "")
    return (spark.read.schema("value string, repo_id string").option("basePath", path).text(path)
            .filter(F.col("value").contains("\t")).filter(F.get(head, 1) == "blob")
            .select("repo_id", name.alias("file_path"), F.get(head, 2).alias("content_sha")))


def write_tree_listing(files: DataFrame, path: str) -> None:
    """``repo_id, file_path, content_sha`` as listings, one folder per repository."""
    line = F.concat(F.lit("100644 blob "), "content_sha", F.lit("\t"), "file_path")
    files.select("repo_id", line.alias("value")).repartition("repo_id").write.mode("append").partitionBy("repo_id").text(path)
