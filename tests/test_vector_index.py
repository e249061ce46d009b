"""The stored index of random-projection buckets against plain search."""

import numpy as np
import pytest

from codestrata.operators import similarity as S, vector_index as V
from tests.conftest import rows
from tests.test_model import _brute

SCHEMA = "vec_id long, embedding array<double>"


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(5)
    corpus = {i: rng.normal(size=6) for i in range(120)}
    corpus.update({i: corpus[7] for i in range(200, 260)})  # a third is one vector
    table = [(i, v.tolist()) for i, v in corpus.items()] + [(900, None)]
    probes = {i: corpus[i] + 0.1 * rng.normal(size=6) for i in range(11)}
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in probes.items()] + [(99, None)], SCHEMA)
    return spark.createDataFrame(table, SCHEMA), asked.withColumnRenamed("vec_id", "probe_id"), corpus, probes


def test_all_buckets_give_the_exact_result(spark, vectors, tmp_path, monkeypatch):
    table, asked, corpus, probes = vectors
    monkeypatch.setattr(V, "SLICE", 16)
    monkeypatch.setattr(V, "BLOCK", 4)
    V.build_index(table, str(tmp_path / "i"), bits=3)
    got = rows(V.search_index(spark, str(tmp_path / "i"), asked, 4, 0.2, share=1.0), "probe_id", "vec_id", "rank")
    assert sorted(got) == _brute(probes, corpus, 4, 0.2)
    assert spark.read.parquet(str(tmp_path / "i" / "sizes")).agg({"slices": "max"}).first()[0] >= 4


def test_nearest_buckets_cost_least():
    rng = np.random.default_rng(2)
    units = rng.normal(size=(5, 8))
    at = units @ V.directions(8, 4)
    for row, got in zip(at, V.nearest_buckets(units, 4, 16)):
        cost = lambda code: sum(x * x for i, x in enumerate(row) if (x > 0) != bool(code >> i & 1))
        assert got[0] == sum(int(x > 0) << i for i, x in enumerate(row)) and sorted(got) == list(range(16))
        assert [round(cost(c), 9) for c in got] == sorted(round(cost(c), 9) for c in range(16))


def test_fewer_buckets_keep_near_copies(spark, vectors, tmp_path):
    table, asked, _, _ = vectors
    V.build_index(table, str(tmp_path / "i"), bits=6)
    exact = set(rows(S.most_similar(asked, table, 1), "probe_id", "vec_id"))
    found = set(rows(V.search_index(spark, str(tmp_path / "i"), asked, 1, share=0.25), "probe_id", "vec_id"))
    assert len(exact & found) >= 0.9 * len(exact)


def test_empty_tables(spark, vectors, tmp_path):
    table, asked, _, _ = vectors
    V.build_index(table.limit(0), str(tmp_path / "e"))
    assert V.search_index(spark, str(tmp_path / "e"), asked).count() == 0
    V.build_index(table, str(tmp_path / "i"), bits=2)
    assert V.search_index(spark, str(tmp_path / "i"), asked.limit(0)).count() == 0
