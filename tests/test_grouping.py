"""Spread-out grouping: exact results with one key holding most rows."""

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from codestrata.operators.grouping import exact_quantiles, hash_share, nested
from tests.conftest import rows


def test_nested_has_one_shape_at_any_size(spark):
    df = spark.range(25_003).select(F.when(F.col("id") < 25_000, "hot").otherwise("cold").alias("k"),
                                    F.col("id").cast("string").alias("v"))
    found = {r["k"]: r["vs"] for r in nested(df, ["k"], F.col("v"), "vs").collect()}
    assert found == {"hot": sorted(map(str, range(25_000))), "cold": ["25000", "25001", "25002"]}


def test_hash_share_is_exact(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("k"), "id")
    for buckets in (4, 4096):
        marked = hash_share(df, ["k"], ["id"], 0.2, 42, "t", buckets)
        got = rows(marked.groupBy("k").agg(F.count("*").alias("n"), F.count_if("t").alias("t")))
        assert got == [("common", 2970, 594), ("rare", 30, 6)]
    again = hash_share(df.repartition(7), ["k"], ["id"], 0.2, 42, "t")
    assert rows(marked.filter("t"), "id") == rows(again.filter("t"), "id")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(0, 5).map(float), st.floats(-1e6, 1e6), st.floats(0, 1e-6)), min_size=1, max_size=60))
def test_quantiles_follow_linear_interpolation(spark, values):
    df = spark.createDataFrame([("r", float(v), float(-v)) for v in values], "k string, a double, b double")
    got = exact_quantiles(df, ["k"], {"x": ("a", 0.75), "y": ("b", 0.2)}, bins=8).collect()[0]
    assert np.isclose(got["x"], np.quantile(values, 0.75), rtol=1e-9, atol=1e-12)
    assert np.isclose(got["y"], np.quantile([-v for v in values], 0.2), rtol=1e-9, atol=1e-12)


def test_quantiles_with_a_far_outlier(spark):
    df = spark.range(1, 10001).select(F.lit("r").alias("k"), F.when(
        F.col("id") == 1, 1e12).otherwise(F.col("id") % 1000).cast("double").alias("v"))
    values = [1e12] + [float(i % 1000) for i in range(2, 10001)]
    got = exact_quantiles(df, ["k"], {"m": ("v", 0.5), "h": ("v", 0.9)}).collect()[0]
    assert (got["m"], got["h"]) == (np.quantile(values, 0.5), np.quantile(values, 0.9))
