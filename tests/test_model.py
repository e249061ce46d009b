"""Features, labels, training and similarity."""

import numpy as np
from pyspark.sql import functions as F

from codestrata.functions.fixed_values import FEATURE_NAMES
from codestrata.operators import hotspot_model as M, similarity as S
from codestrata.plans import workload as X
from codestrata.plans.dashboard import dashboard
from codestrata.sources.synthetic import synthetic_changes
from tests.conftest import rows


def _training(spark):
    rows_ = synthetic_changes(spark, 600).withColumn("file_path", F.concat(F.lit("f"), (F.rand(1) * 150).cast("int").cast("string"), F.lit(".py")))
    features = M.engineer_features(rows_)
    return features.withColumn("is_hotspot", F.col("lines_changed_sum") > 22)


def test_single_touch_has_zero_deviation(spark):
    row = spark.createDataFrame([("r", "f", 4, 3, 1, 1, 2, False)],
                                "repo_id string, file_path string, lines_changed long, insertions long, deletions long, "
                                "commit_frequency long, author_count long, is_hotspot boolean")
    f = M.engineer_features(row).collect()[0]
    assert f["lines_changed_std"] == 0.0 and f["change_rate"] == 2.0 and f["insertion_deletion_ratio"] == 1.5
    assert set(FEATURE_NAMES) < set(f.asDict())


def test_train_save_load_score(spark, tmp_path):
    data = M.stratified_split(_training(spark))
    model = M.train_hotspot_model(data.filter("NOT is_test"), trees=10, depth=4)
    path = str(tmp_path / "model")
    assert M.load_model_or_none(spark, path) is None
    M.save_model(model, path)
    scored = M.score_hotspots(M.load_model_or_none(spark, path), data)
    assert scored.filter("score < 0 OR score > 1").isEmpty()
    assert M.accuracy(scored.filter("is_test"), "is_hotspot").collect()[0][0] > 0.9
    assert rows(scored, "file_path", "score") == rows(M.score_hotspots(model, data), "file_path", "score")
    top = M.feature_importance(spark, model).collect()
    assert len(top) == 10 and top[0]["importance"] >= top[-1]["importance"]


def test_single_class_scores_one(spark):
    cold = _training(spark).withColumn("is_hotspot", F.lit(False))
    model = M.train_hotspot_model(cold, trees=3, depth=2)
    assert rows(M.score_hotspots(model, cold).select("score").distinct()) == [(1.0,)]


def test_dashboard_takes_a_model_or_none(spark, data):
    cold = _training(spark).withColumn("is_hotspot", F.lit(False))
    model = M.train_hotspot_model(cold, trees=3, depth=2)
    c, f = X.commits(spark, data, n=200), X.file_changes(spark, data, n=200)
    plain, scored = dashboard(c, f), dashboard(c, f, model=model)
    states = lambda d: {s["status"] for r in d.collect() for s in r["subsystem_health"]}
    assert states(scored) == {"critical"} and states(plain) - {"critical"}
    alerts = lambda d: {a["severity"] for r in d.collect() for a in r["refactor_alerts"]}
    assert alerts(scored) == {"high"}
    assert M.file_scores(None, None) is None and M.subsystem_scores(None, None) is None


def test_basic_model(spark):
    features = _training(spark).select("file_path", F.col("lines_changed_sum").alias("lines_changed"),
                                       F.col("commit_frequency_sum").alias("commit_frequency"),
                                       F.col("author_diversity").alias("complexity"), "change_rate",
                                       "insertion_deletion_ratio", "is_hotspot")
    model = M.train_hotspot_model(features, M.BASIC_FEATURE_NAMES, trees=3, depth=2)
    assert model.stages[0].getInputCols() == list(M.BASIC_FEATURE_NAMES)


def test_unstratified_split_is_exact(spark):
    split = M.stratified_split(_training(spark), stratified=False)
    total, test = split.count(), split.filter("is_test").count()
    assert test == int(total * 0.2) and "_all" not in split.columns


def test_author_count_looks_at_ten_commits(spark):
    c = spark.createDataFrame([("r", f"{i:02}", i, f"p{i}@x" if i < 5 else "same@x") for i in range(15)],
                              "repo_id string, commit_hash string, t long, author_email string").select(
        "*", F.timestamp_seconds("t").alias("committed_at"))
    f = spark.createDataFrame([("r", f"{i:02}", "a.py") for i in range(15)], "repo_id string, commit_hash string, file_path string")
    assert rows(M.recent_author_count(c, f), "author_count") == [(1,)]
    assert rows(M.recent_author_count(c, f, 15), "author_count") == [(6,)]


def _brute(probes, corpus, k, low):
    out = []
    for p, a in probes.items():
        sims = [(-float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8)), i) for i, b in corpus.items()]
        out += [(p, i, r + 1) for r, (s, i) in enumerate(sorted((round(s, 9), i) for s, i in sims if -s >= low)[:k])]
    return sorted(out)


def test_most_similar_in_blocks(spark):
    rng = np.random.default_rng(5)
    corpus = {i: rng.normal(size=6) for i in range(120)}
    probes = {i: corpus[i] + 0.1 * rng.normal(size=6) for i in range(11)}
    schema = "vec_id long, embedding array<double>"
    c = spark.createDataFrame([(i, v.tolist()) for i, v in corpus.items()], schema).repartition(5)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in probes.items()], schema).withColumnRenamed("vec_id", "probe_id")
    for block in (512, 3):
        got = rows(S.most_similar(p, c, 4, 0.2, block=block), "probe_id", "vec_id", "rank")
        assert sorted(got) == _brute(probes, corpus, 4, 0.2)


def test_importance_tells_texts_apart(spark):
    df = spark.createDataFrame([("fix the bug",), ("add a feature",), ("fix the loader bug",), (None,)], "message string")
    out = S.importance(S.embed_text(df, "message", dimensions=64)).collect()
    assert [r["n_tokens"] for r in out] == [3, 3, 4, 1] and len({round(r["importance"], 6) for r in out[:3]}) == 3
    one, two, three = (np.array(out[k]["embedding"]) / out[k]["importance"] for k in (0, 1, 2))
    assert one @ three > one @ two
