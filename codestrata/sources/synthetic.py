"""Synthetic training rows for trying out the model without a history."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _poisson(u: Column, mean: float) -> Column:
    """Inverse of the Poisson distribution function at ``u``."""
    total, term, steps = 0.0, math.exp(-mean), []
    for k in range(int(mean * 6) + 20):
        total += term
        steps.append(total)
        term *= mean / (k + 1)
    reached = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s < u)
    return F.size(reached).cast("long")


def synthetic_changes(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` rows: lines, insertions, deletions ~ Poisson(5, 3, 2), frequency ~ Poisson(1) + 1."""
    i = F.col("id")
    return spark.range(n).select(
        F.lit("synthetic").alias("repo_id"),
        F.concat(F.lit("src/module_"), (i % 50).cast("string"), F.lit("/file_"),
                 i.cast("string"), F.lit(".py")).alias("file_path"),
        _poisson(F.rand(seed), 5).alias("lines_changed"),
        _poisson(F.rand(seed + 1), 3).alias("insertions"),
        _poisson(F.rand(seed + 2), 2).alias("deletions"),
        (_poisson(F.rand(seed + 3), 1) + 1).alias("commit_frequency"),
        (F.floor(F.rand(seed + 4) * 5) + 1).alias("author_count"),
        F.lit(False).alias("is_hotspot"))
