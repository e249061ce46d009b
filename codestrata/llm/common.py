"""Helpers of the text operators: byte words, bounded Arrow slices, stored steps, linked groups."""

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.grouping import skew_join
from ..session import shared_folder

#: A-Z become a-z, every other ASCII byte outside 0-9 and a-z a space; bytes from 0x80 on stay.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256))

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder and read it back: later jobs neither repeat it nor lose it.

    Each application keeps its steps in one folder, which goes when the driver ends. The shuffle files of the step go
    as soon as it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
        atexit.register(_drop, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored = path
    return back


def let_go(*steps: DataFrame) -> None:
    """Delete stored steps that no later job reads."""
    for step in steps:
        _delete(step.sparkSession.sparkContext, step._stored)


def _drop(folder: str) -> None:
    context = _folders[folder].sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    _delete(context, folder)


def _delete(context, name: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice hold about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null reads as empty."""
    at = batch.schema.get_field_index(column)
    return batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index linked to each of ``n`` nodes by the pairs (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def linked_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: ``node, root`` with the smallest node as root.

    Alternates two star steps on written tables until no edge moves. Every round keeps at most as
    many edges as it got. Minima are combined before the exchange, so a node with a large share
    of the edges costs one row per task there; where its edges get their minimum, the hot key is cut. Nodes without
    edges are not returned.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (skew_join(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (skew_join(large, least, ["u"])
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("s"))
                 .select("s.u", "s.v").filter("u > v").distinct())
        last, e = e, stored(small)
        let_go(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
