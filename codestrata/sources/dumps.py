"""History dumps as a data source: batches by byte range, streams by appended bytes.

The format is that of ``exports.py``. Register once, then read like any other format::

    spark.dataSource.register(HistoryDumps)
    spark.read.format("history_dump").option("path", folder).load()
    spark.readStream.format("history_dump").option("path", folder).load()
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.rules import author_label
from .exports import BODY, FIELD, RECORD
from .folders import below, listed, open_folder

SCHEMA = ("repo_id string, commit_hash string, parent_hash string, committed_at bigint, author_name string, "
          "author_email string, message string, "
          "files array<struct<file_path: string, insertions: bigint, deletions: bigint>>")
FILES = pa.list_(pa.struct([("file_path", pa.string()), ("insertions", pa.int64()), ("deletions", pa.int64())]))
ARROW = pa.schema([("repo_id", pa.string()), ("commit_hash", pa.string()), ("parent_hash", pa.string()),
                   ("committed_at", pa.int64()), ("author_name", pa.string()), ("author_email", pa.string()),
                   ("message", pa.string()), ("files", FILES)])
PART_BYTES = 64 << 20
CHUNK = 1 << 20
#: Bytes read at first beyond the end of a range, for the record that runs over it; doubled until it ends.
STEP = 4 << 10
#: Partitions among which the bytes are dealt out where the reader is not told how many.
TASKS = 200
ROWS = 2_000


@dataclass
class Range(InputPartition):
    """Records that begin in the bytes [start, end) of a file, which is read no further than ``limit``."""

    path: str
    start: int
    end: int
    limit: int


@dataclass
class Share(InputPartition):
    """What one task reads: spans of files, each in ranges of ``size`` bytes."""

    spans: list[Range]
    size: int

    def ranges(self) -> Iterator[Range]:
        for span in self.spans:
            for at in range(span.start, span.end, self.size):
                yield Range(span.path, at, min(at + self.size, span.end), span.limit)


def repo_name(path: str) -> str:
    """The folder named ``repo_id=...`` if there is one, else the path without its last ending."""
    for part in path.split("/"):
        if part.startswith("repo_id="):
            return part[len("repo_id="):]
    head, _, tail = path.rpartition(".")
    return head if head and "/" not in tail else path


def dump_files(folder: str) -> dict[str, int]:
    """Size of every dump below the folder, by path relative to it; names that begin with ``_`` or ``.`` are left out."""
    system, root = open_folder(folder)
    sizes, waiting = {}, [root]
    while waiting:
        for entry in listed(system, waiting.pop()):
            if entry.base_name.startswith(("_", ".")):
                continue
            if entry.type == fs.FileType.Directory:
                waiting.append(entry.path)
            elif entry.size:
                sizes[below(root, entry.path)] = entry.size
    return sizes


def ranges(spans: dict[str, tuple[int, int]], size: int) -> list[Range]:
    """Each span of a file in pieces of ``size`` bytes."""
    return [Range(path, at, min(at + size, end), end)
            for path, (start, end) in sorted(spans.items()) for at in range(start, end, size)]


def shares(spans: dict[str, tuple[int, int]], size: int, tasks: int) -> list[Share]:
    """The ranges of all spans dealt out in order, so many to a task as hold a ``tasks``-th of the bytes, or ``PART_BYTES``.

    Small ranges thus cost no task each, and large ones stay alone. Ranges that adjoin are kept as one span, so the
    list grows with files and tasks, not with ranges.
    """
    most = min(PART_BYTES, -(-sum(end - start for start, end in spans.values()) // tasks))
    found, held, used = [], [], 0
    for path, (start, end) in sorted(spans.items()):
        at = start
        while at < end:
            if held and used + min(size, end - at) > most:
                found.append(Share(held, size))
                held, used = [], 0
            take = min(max((most - used) // size, 1) * size, end - at)
            held.append(Range(path, at, at + take, end))
            at, used = at + take, used + take
    return [*found, Share(held, size)] if held else found


def records(stream, part: Range) -> Iterator[bytes]:
    """The records that begin inside the range, each whole; a chunk and a record are in memory at a time."""
    mark = RECORD.encode()
    stream.seek(part.start)
    held, at, begun, step = b"", part.start, False, STEP  # ``at`` is the place of the first byte of ``held``
    while True:
        inside = part.end - at - len(held)
        if inside <= 0:
            inside, step = step, step * 2
        chunk = stream.read(min(CHUNK, inside, part.limit - at - len(held)))
        if not chunk:
            if begun and held:
                yield held
            return
        held += chunk
        while True:
            if not begun:
                place = held.find(mark)
                if place < 0 or at + place >= part.end:
                    if place >= 0 or at + len(held) >= part.end:
                        return
                    at, held = at + len(held), b""
                    break
                at, held, begun = at + place + 1, held[place + 1:], True
            place = held.find(mark)
            if place < 0:
                break
            yield held[:place]
            at, held = at + place, held[place:]
            begun = False


def parsed(record: bytes, repo: str) -> tuple | None:
    """One commit of a dump, None for anything else."""
    text = record.decode("utf-8", "replace")
    head, _, stat = text.partition(BODY)
    parts = head.split(FIELD, 5)
    if len(parts) < 6:
        return None
    files = []
    for line in stat.split("\n"):
        cells = line.split("\t", 2)
        if len(cells) == 3 and cells[2] and all(c == "-" or c.isascii() and c.isdigit() for c in cells[:2]):
            files.append((cells[2], *[0 if c == "-" else int(c) for c in cells[:2]]))
    seconds = parts[2].strip()
    return (repo, parts[0], parts[1].split(" ", 1)[0] or None, int(seconds) if seconds.lstrip("-").isdigit() else None,
            parts[3], parts[4], parts[5], [dict(zip(("file_path", "insertions", "deletions"), f)) for f in files])


def batches(folder: str, share: Share) -> Iterator[pa.RecordBatch]:
    system, root = open_folder(folder)
    rows = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    for path, parts in groupby(share.ranges(), lambda part: part.path):
        repo = repo_name(path)
        with system.open_input_file(f"{root}/{path}") as stream:
            for part in parts:
                for record in records(stream, part):
                    row = parsed(record, repo)
                    if row:
                        rows.append(row)
                    if len(rows) == ROWS:
                        yield batch()
                        rows.clear()
    if rows:
        yield batch()


class HistoryDumps(DataSource):
    """Options: ``path``, the folder; ``partBytes``, the bytes of a range (64 MB); ``tasks``, among which ranges are dealt (200)."""

    @classmethod
    def name(cls) -> str:
        return "history_dump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "DumpReader":
        return DumpReader(self.options)

    def streamReader(self, schema: StructType) -> "DumpStreamReader":
        return DumpStreamReader(self.options)


class DumpReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.size = int(options.get("partBytes", PART_BYTES))
        self.tasks = int(options.get("tasks", TASKS))

    def partitions(self) -> list[Share]:
        spans = {path: (0, size) for path, size in dump_files(self.folder).items()}
        return shares(spans, self.size, self.tasks) or [Share([], self.size)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return batches(self.folder, partition)


class DumpStreamReader(DumpReader, DataSourceStreamReader):
    """Offsets are bytes read by file. Dumps grow by whole records, in one write each; a new file is read from its start.

    A file that was replaced by a shorter one is taken as new.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dump_files(self.folder)

    def partitions(self, start: dict, end: dict) -> list[Share]:
        spans = {path: (start.get(path, 0) if start.get(path, 0) <= size else 0, size)
                 for path, size in end.items() if start.get(path) != size}
        return shares(spans, self.size, self.tasks)


def read_dumps(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, stream: bool = False) -> DataFrame:
    """Commits with their nested files, as rows or as a stream."""
    spark.dataSource.register(HistoryDumps)
    reader = spark.readStream if stream else spark.read
    rows = (reader.format("history_dump").option("path", path).option("partBytes", part_bytes)
            .option("tasks", spark.sparkContext.defaultParallelism * 4).load())
    return rows.withColumn("committed_at", F.timestamp_seconds("committed_at"))


def commits_of(dumps: DataFrame) -> DataFrame:
    return dumps.select("repo_id", "commit_hash", "parent_hash", "committed_at", "author_name", "author_email",
                        author_label(F.col("author_name"), F.col("author_email")).alias("author"), "message")


def changes_of(dumps: DataFrame) -> DataFrame:
    """One row per commit and file; the dump carries no complexities."""
    none = F.lit(None).cast("double")
    return (dumps.select("repo_id", "commit_hash", F.inline("files"))
            .withColumn("lines", F.col("insertions") + F.col("deletions"))
            .withColumn("complexity_before", none).withColumn("complexity_after", none))


def write_dumps(commits: DataFrame, file_changes: DataFrame, path: str, mode: str = "append") -> None:
    """One dump per repository and call below ``path``, newest commits first.

    The files of a commit are one text; commits stay rows. A repository is written by one task, as its dump
    is one file.
    """
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stat = file_changes.groupBy("repo_id", "commit_hash").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws("\t", F.col("insertions").cast("string"), F.col("deletions").cast("string"), "file_path"))), "\n").alias("_stat"))
    head = [field("commit_hash"), field("parent_hash"), F.unix_timestamp("committed_at").cast("string"),
            field("author_name"), field("author_email"), field("message")]
    text = F.concat(F.lit(RECORD), F.concat_ws(FIELD, *head), F.lit(BODY + "\n"), F.coalesce("_stat", F.lit("")), F.lit("\n"))
    rows = commits.join(stat, ["repo_id", "commit_hash"], "left").select("repo_id", "committed_at", "commit_hash", text.alias("value"))
    (rows.repartition("repo_id").sortWithinPartitions("repo_id", F.desc("committed_at"), F.desc("commit_hash"))
     .select("repo_id", "value").write.mode(mode).partitionBy("repo_id").option("lineSep", "\n").text(path))
