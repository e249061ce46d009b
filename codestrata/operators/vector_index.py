"""A stored index of random-projection buckets, and searches that join probes to it by bucket."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .similarity import ranked, unit_rows

SEED = 29
BITS = 10
#: Vectors of one bucket that are compared at a time, and probes that meet them at a time.
SLICE, BLOCK = 4_096, 1_024


@lru_cache(4)
def directions(width: int, bits: int) -> np.ndarray:
    """``bits`` fixed orthogonal directions, one per column; more bits than dimensions begin a new set."""
    rng = np.random.default_rng(SEED)
    sets = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-bits // width))]
    return np.concatenate(sets, axis=1)[:, :bits]


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if len(rows) else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), kind))


def buckets_of(units: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each vector: one bit per direction it points along."""
    return ((units @ directions(units.shape[1], bits) > 0) << np.arange(bits)).sum(1)


def nearest_buckets(units: np.ndarray, bits: int, visits: int) -> np.ndarray:
    """Of each probe the ``visits`` buckets that cost least: a bit that differs costs the square of its projection."""
    at = units @ directions(units.shape[1], bits)
    codes = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    square = at ** 2
    # |code - own| summed with weights, as two products in place of a table of all three.
    own = (at > 0).astype(np.float64)
    cost = (square * own).sum(1)[:, None] + (square * (1 - 2 * own)) @ codes.T
    return np.argsort(cost, axis=1, kind="stable")[:, :visits]


def build_index(corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", bits: int = BITS) -> None:
    """Write every row that has a vector to ``path``: its key, its vector of length one, its bucket and slice.

    Rows are ordered by bucket, so that a search reads the row groups of its buckets only. A bucket is dealt over slices of about
    ``SLICE`` rows, so copies of one vector, however many, never meet in one task. ``path/sizes`` holds the
    number of slices of each bucket, at most ``2 ** bits`` rows.
    """
    rows = corpus.select(F.col(key).alias("key"), F.col(vector).alias("unit")).filter("unit is not null")
    width = rows.agg(F.max(F.size("unit"))).first()[0] or 1
    schema = rows.select("key", F.expr("cast(array() as array<double>)").alias("unit"), F.lit(0).cast("int").alias("bucket")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(units, pa.float64()),
                                              pa.array(buckets_of(units, bits), pa.int32())], names=["key", "unit", "bucket"])

    coded = f"{path}/coded"
    rows.mapInArrow(run, schema).withColumn("place", F.xxhash64(F.monotonically_increasing_id())).write.parquet(coded)
    table = corpus.sparkSession.read.parquet(coded)
    (table.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
     .withColumns({"bits": F.lit(bits), "width": F.lit(width)}).coalesce(1).write.parquet(f"{path}/sizes"))
    sizes = corpus.sparkSession.read.parquet(f"{path}/sizes")
    (table.join(F.broadcast(sizes.select("bucket", "slices")), "bucket")
     .select("key", "unit", "bucket", F.pmod("place", F.col("slices")).cast("int").alias("slice"))
     .repartitionByRange("bucket", "slice").sortWithinPartitions("bucket", "slice").write.parquet(f"{path}/rows"))


def search_index(spark: SparkSession, path: str, probes: DataFrame, k: int = 10, threshold: float = -1.0,
                 share: float = 0.65, probe_key: str = "probe_id", key: str = "vec_id") -> DataFrame:
    """``probe_key, key, similarity, rank``: the ``k`` most similar stored vectors in the probe's nearest buckets.

    Each probe visits ``share`` of all buckets, those that its projections cost least; similarities are exact, and with a
    share of 1 so is the result. Probes are rows of a table from start to end: they are joined to the index by bucket and
    slice, in blocks, each group keeps its best ``k`` per probe, and the final ranking sees only those.
    """
    sizes = spark.read.parquet(f"{path}/sizes")
    known = sizes.select("bits", "width").first()
    rows = spark.read.parquet(f"{path}/rows")
    id_type, probe_type = rows.schema["key"].dataType.simpleString(), probes.schema[probe_key].dataType.simpleString()
    out = f"{probe_key} {probe_type}, {key} {id_type}, similarity double"
    if known is None:
        return spark.createDataFrame([], out + ", rank int")
    bits, width = known
    visits = max(1, round(share * (1 << bits)))
    asked = probes.select(F.col(probe_key).alias("probe"), F.col("embedding").alias("unit")).filter("unit is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    sent = asked.select("probe", F.expr("cast(array() as array<double>)").alias("unit"),
                        F.expr("cast(array() as array<int>)").alias("buckets")).schema

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                units = unit_rows(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), listed(units, pa.float64()),
                     listed(nearest_buckets(units, bits, visits).astype(np.int32), pa.int32())], names=["probe", "unit", "buckets"])

    numbered = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cell = ["bucket", "slice", "block"]
    left = (asked.mapInArrow(route, sent).withColumn("block", F.pmod(F.xxhash64("probe"), F.lit(blocks)).cast("int"))
            .select("probe", "unit", "block", F.explode("buckets").alias("bucket"))
            .join(F.broadcast(sizes.select("bucket", "slices")), "bucket")  # at most 2 ** bits rows
            .select("probe", "unit", "block", "bucket", numbered(F.col("slices")).alias("slice")))
    right = rows.withColumn("block", numbered(F.lit(blocks)))

    return ranked(left.groupBy(*cell).cogroup(right.groupBy(*cell)), k, threshold,
                  (probe_key, probes.schema[probe_key].dataType), (key, rows.schema["key"].dataType))
