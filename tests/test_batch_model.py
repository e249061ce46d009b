"""A model of the caller applied in batches, against the same model in plain Python."""

from hashlib import md5

import numpy as np
import pytest

from codestrata.operators import batch_model as B


def test_model_vectors(spark, tmp_path):
    table = np.random.default_rng(2).normal(size=(32, 3))
    folder = str(tmp_path / "model")
    B.save_arrays(spark, {"rows": table}, folder)
    arrays = B.load_arrays(spark, folder)
    assert np.array_equal(arrays["rows"], table)
    texts = [None, "", "one", "One TWO\tone", "\u00c4pfel \u00e4pfel\u00a0x", "w " * 50_000, "one"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id long, text string, embedding string")
    got = {r["id"]: r["embedding"] for r in B.model_vectors(df, "text", arrays, B.mean_word_rows, batch=2).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = [w.lower() for w in (text or "").encode().split()]
        rows = [table[int(md5(w).hexdigest()[:4], 16) % 32] for w in words]
        assert np.allclose(got[i], np.mean(rows, axis=0) if rows else np.zeros(3), atol=1e-9)
    assert got[2] == got[6]
    assert B.model_vectors(df.limit(0), "text", arrays, B.mean_word_rows).collect() == []


def test_a_model_beyond_the_bound_is_refused(spark, tmp_path):
    folder = str(tmp_path / "model")
    B.save_arrays(spark, {"rows": np.zeros((8, 8))}, folder)
    with pytest.raises(ValueError):
        B.load_arrays(spark, folder, most_bytes=511)
