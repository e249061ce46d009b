"""Checked queries: the hotspot model and the streams."""

import uuid

from pyspark.sql import functions as F

from ..operators import history as H, hotspot_model as M, insights as I
from ..session import cut_lineage, shared_folder
from ..streaming import rolling
from . import workload as X
from .checks_insights import SCORES, SPREAD
from .registry import query

ROWS = """, source AS (SELECT * FROM changes WHERE regexp_matches(file_path, '\\.(py|js|java|cpp|c|ts|rb|go)$')),
people AS (SELECT repo_id, file_path, count(DISTINCT author_email) AS author_count FROM (
  SELECT s.repo_id, s.file_path, c.author_email, row_number() OVER (PARTITION BY s.repo_id, s.file_path
         ORDER BY c.committed_at DESC, c.commit_hash DESC) AS rn
  FROM source s JOIN commits c USING (repo_id, commit_hash) QUALIFY rn <= 10) GROUP BY 1, 2),
rows_ AS (SELECT s.repo_id, s.file_path, s.lines AS lines_changed, s.insertions, s.deletions,
  1::BIGINT AS commit_frequency, p.author_count, false AS is_hotspot FROM source s JOIN people p USING (repo_id, file_path)),
base AS (SELECT repo_id, file_path, CAST(sum(lines_changed) AS BIGINT) AS lines_changed_sum, avg(lines_changed) AS lines_changed_mean,
  coalesce(stddev_samp(lines_changed), 0.0) AS lines_changed_std, CAST(sum(insertions) AS BIGINT) AS insertions_sum,
  avg(insertions) AS insertions_mean, CAST(sum(deletions) AS BIGINT) AS deletions_sum, avg(deletions) AS deletions_mean,
  count(*) AS commit_frequency_sum, max(author_count) AS author_count_max, bool_or(is_hotspot) AS is_hotspot
  FROM rows_ GROUP BY 1, 2),
features AS (SELECT *, lines_changed_sum / (commit_frequency_sum + 1)::DOUBLE AS change_rate,
  insertions_sum / (deletions_sum + 1)::DOUBLE AS insertion_deletion_ratio,
  lines_changed_std / (lines_changed_mean + 1) AS change_volatility,
  author_count_max / (commit_frequency_sum + 1)::DOUBLE AS author_diversity FROM base),
basic AS (SELECT repo_id, file_path, CAST(sum(lines) AS BIGINT) AS lines_changed, CAST(sum(insertions) AS BIGINT) AS insertions,
  CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS commit_frequency, avg(complexity_after) AS complexity,
  sum(lines) / count(*)::DOUBLE AS change_rate, sum(insertions) / (sum(deletions) + 1)::DOUBLE AS insertion_deletion_ratio
  FROM changes GROUP BY 1, 2),
labeled AS (SELECT b.*, b.commit_frequency > q.f AND b.complexity > q.c AS is_hotspot FROM basic b JOIN (
  SELECT repo_id, quantile_cont(commit_frequency, 0.75) AS f, quantile_cont(complexity, 0.75) AS c FROM basic GROUP BY 1) q USING (repo_id))"""
BASIC_COLUMNS = """repo_id, file_path, lines_changed, insertions, deletions, commit_frequency, round(complexity, 6) AS complexity,
  round(change_rate, 6) AS change_rate, round(insertion_deletion_ratio, 6) AS insertion_deletion_ratio"""


def _rows(spark, sf):
    return M.training_rows(X.commits(spark, sf), X.file_changes(spark, sf))


def _labeled(spark, sf):
    touches = X.file_changes(spark, sf).withColumnRenamed("complexity_after", "complexity")
    return M.label_hotspots(M.engineer_features_basic(touches))


@query("m1_training_rows", ROWS + "SELECT * FROM rows_")
def _(spark, sf):
    return _rows(spark, sf)


@query("m2_recent_author_count", ROWS + "SELECT * FROM people")
def _(spark, sf):
    from ..functions.paths import is_source
    changes = X.file_changes(spark, sf).filter(is_source(F.col("file_path")))
    return M.recent_author_count(X.commits(spark, sf), changes)


@query("m3_engineer_features", ROWS + """
SELECT repo_id, file_path, lines_changed_sum, round(lines_changed_mean, 6) AS lines_changed_mean,
  round(lines_changed_std, 6) AS lines_changed_std, insertions_sum, round(insertions_mean, 6) AS insertions_mean,
  deletions_sum, round(deletions_mean, 6) AS deletions_mean, commit_frequency_sum, author_count_max,
  round(change_rate, 6) AS change_rate, round(insertion_deletion_ratio, 6) AS insertion_deletion_ratio,
  round(change_volatility, 6) AS change_volatility, round(author_diversity, 6) AS author_diversity, is_hotspot FROM features""")
def _(spark, sf):
    return M.engineer_features(_rows(spark, sf))


@query("m4_derived_features", ROWS + """
SELECT repo_id, file_path, round(change_rate, 6) AS change_rate, round(insertion_deletion_ratio, 6) AS insertion_deletion_ratio,
  round(change_volatility, 6) AS change_volatility, round(author_diversity, 6) AS author_diversity FROM features""")
def _(spark, sf):
    return M.engineer_features(_rows(spark, sf)).select(
        "repo_id", "file_path", "change_rate", "insertion_deletion_ratio", "change_volatility", "author_diversity")


@query("m5_label_hotspots_synthetic", ROWS + """
SELECT f.repo_id, f.file_path, f.commit_frequency_sum > q.f AND f.lines_changed_sum > q.l AND f.author_count_max > 2 AS is_hotspot
FROM features f JOIN (SELECT repo_id, quantile_cont(commit_frequency_sum, 0.8) AS f, quantile_cont(lines_changed_sum, 0.7) AS l
  FROM features GROUP BY 1) q USING (repo_id)""")
def _(spark, sf):
    rows = M.label_hotspots_synthetic(M.engineer_features(_rows(spark, sf)).drop("is_hotspot"),
                                      "commit_frequency_sum", "lines_changed_sum", "author_count_max")
    return rows.select("repo_id", "file_path", "is_hotspot")


@query("m6_label_hotspots", ROWS + "SELECT repo_id, file_path, is_hotspot FROM labeled")
def _(spark, sf):
    return _labeled(spark, sf).select("repo_id", "file_path", "is_hotspot")


@query("m7_basic_features", ROWS + f"SELECT {BASIC_COLUMNS} FROM basic")
def _(spark, sf):
    touches = X.file_changes(spark, sf).withColumnRenamed("complexity_after", "complexity")
    return M.engineer_features_basic(touches)


@query("m8_class_balance", ROWS + """
SELECT repo_id, is_hotspot, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY repo_id)::DOUBLE, 6) AS share
FROM labeled GROUP BY 1, 2""")
def _(spark, sf):
    return M.class_balance(_labeled(spark, sf))


@query("m9_stratified_split", ROWS + """, c AS (SELECT is_hotspot, count(*) AS n FROM labeled GROUP BY 1)
SELECT is_hotspot, true AS is_test, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n FROM c
UNION ALL SELECT is_hotspot, false, n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) FROM c""")
def _(spark, sf):
    return M.stratified_split(_labeled(spark, sf)).groupBy("is_hotspot", "is_test").agg(F.count(F.lit(1)).alias("n"))


def _forest(spark, sf):
    """Split, then fit the forest of the short variant on the training part."""
    parts = M.stratified_split(_labeled(spark, sf).fillna(0.0, ["complexity"]))
    model = M.train_basic_model(parts.filter(~F.col("is_test")))
    return model, parts


SYNTHETIC = ROWS + """, told AS (
SELECT f.repo_id, f.file_path, f.commit_frequency_sum > q.f AND f.lines_changed_sum > q.l AND f.author_count_max > 2 AS is_hotspot
FROM features f JOIN (SELECT repo_id, quantile_cont(commit_frequency_sum, 0.8) AS f, quantile_cont(lines_changed_sum, 0.7) AS l
  FROM features GROUP BY 1) q USING (repo_id))"""


@query("m11_train_and_score", SYNTHETIC + """
SELECT repo_id, file_path, is_hotspot, true AS a_probability, true AS a_class FROM told""")
def _(spark, sf):
    """The full forest, 13 features and 200 trees: which rows it scores, and that scores are probabilities."""
    rows = M.label_hotspots_synthetic(M.engineer_features(_rows(spark, sf)).drop("is_hotspot"),
                                      "commit_frequency_sum", "lines_changed_sum", "author_count_max")
    rows = cut_lineage(rows)
    scored = M.score_hotspots(M.train_hotspot_model(rows), rows)
    return scored.select("repo_id", "file_path", "is_hotspot", F.col("score").between(0.0, 1.0).alias("a_probability"),
                         F.col("prediction").isin(0.0, 1.0).alias("a_class"))


@query("m10_scaler", ROWS + """
SELECT unnest(['lines_changed', 'commit_frequency', 'complexity', 'change_rate', 'insertion_deletion_ratio']) AS feature,
  unnest([round(avg(lines_changed), 6), round(avg(commit_frequency), 6), round(avg(coalesce(complexity, 0)), 6),
          round(avg(change_rate), 6), round(avg(insertion_deletion_ratio), 6)]) AS mean,
  unnest([round(stddev_samp(lines_changed), 6), round(stddev_samp(commit_frequency), 6), round(stddev_samp(coalesce(complexity, 0)), 6),
          round(stddev_samp(change_rate), 6), round(stddev_samp(insertion_deletion_ratio), 6)]) AS deviation FROM labeled""")
def _(spark, sf):
    model = M.train_basic_model(_labeled(spark, sf).fillna(0.0, ["complexity"]))
    names, scaler = model.stages[0].getInputCols(), model.stages[1]
    rows = [(n, float(m), float(d)) for n, m, d in zip(names, scaler.mean.toArray(), scaler.std.toArray())]
    return spark.createDataFrame(rows, "feature string, mean double, deviation double")


@query("m12_one_class_score", ROWS + "SELECT repo_id, file_path, 1.0::DOUBLE AS score FROM labeled")
def _(spark, sf):
    rows = cut_lineage(_labeled(spark, sf).fillna(0.0, ["complexity"]).withColumn("is_hotspot", F.lit(False)))
    return M.score_hotspots(M.train_basic_model(rows), rows).select("repo_id", "file_path", "score")


@query("k2_k3_stored_model", ROWS + "SELECT repo_id, file_path, true AS same_score FROM labeled")
def _(spark, sf):
    model, parts = _forest(spark, sf)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    M.save_model(model, path)
    before = M.score_hotspots(model, parts).select("repo_id", "file_path", "score")
    after = M.score_hotspots(M.load_model_or_none(spark, path), parts).select(
        "repo_id", "file_path", F.col("score").alias("_after"))
    return before.join(after, ["repo_id", "file_path"]).select(
        "repo_id", "file_path", (F.col("score") == F.col("_after")).alias("same_score"))


@query("m13_model_report", ROWS + """, c AS (SELECT is_hotspot, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS n FROM labeled GROUP BY 1)
SELECT CAST(is_hotspot AS INT)::DOUBLE AS class, n AS support, true AS shares FROM c WHERE n > 0""")
def _(spark, sf):
    """Support per class of the test rows, and that precision, recall and F1 are shares."""
    model, parts = _forest(spark, sf)
    scored = M.score_hotspots(model, parts.filter("is_test"))
    shares = F.greatest("precision", "recall", "f1").between(0.0, 1.0) & F.least("precision", "recall", "f1").between(0.0, 1.0)
    return M.classification_report(scored, "is_hotspot").filter("support > 0").select("class", "support", shares.alias("shares"))


GUESSED = SCORES + """, g AS (SELECT CAST(risk > 0.6 AS INT)::DOUBLE AS label, CAST(score > 0.5 AS INT)::DOUBLE AS prediction FROM s)"""


def _guesses(spark, sf):
    from ..functions.numbers import file_risk_score
    trends = H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf))
    c, f = F.col("complexity"), F.col("change_frequency")
    return I.with_file_scores(trends).select(
        (file_risk_score(c, f) > 0.6).cast("double").alias("label"), (F.col("score") > 0.5).cast("double").alias("prediction"))


@query("m13_confusion_matrix", GUESSED + "SELECT label, prediction, count(*) AS n FROM g GROUP BY 1, 2")
def _(spark, sf):
    return M.confusion_matrix(_guesses(spark, sf))


@query("m13_classification_report", GUESSED + """, k AS (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS class),
t AS (SELECT k.class, count(*) FILTER (WHERE g.label = k.class) AS support, count(*) FILTER (WHERE g.prediction = k.class) AS guessed,
  count(*) FILTER (WHERE g.label = k.class AND g.prediction = k.class) AS hit FROM k, g GROUP BY 1),
u AS (SELECT *, coalesce(hit / nullif(guessed, 0)::DOUBLE, 0.0) AS p, coalesce(hit / nullif(support, 0)::DOUBLE, 0.0) AS r FROM t)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, support FROM u
WHERE support > 0 OR guessed > 0""")
def _(spark, sf):
    return M.classification_report(_guesses(spark, sf))


@query("m13_accuracy", GUESSED + "SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM g")
def _(spark, sf):
    return M.accuracy(_guesses(spark, sf))


@query("m14_feature_importance", ROWS + """
SELECT 1.0::DOUBLE AS total, 5::BIGINT AS n_features, true AS falling FROM (SELECT count(*) AS n FROM labeled)""")
def _(spark, sf):
    """All five features of the short variant, best first, with importances that add up to 1."""
    model, _ = _forest(spark, sf)
    rows = M.feature_importance(spark, model)
    listed = rows.agg(F.collect_list("importance").alias("x"))
    return listed.select(F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("x").alias("n_features"),
                         (F.col("x") == F.sort_array("x", asc=False)).alias("falling"))


@query("m15_subsystem_features", """, sizes AS (SELECT repo_id, commit_hash, count(*) AS f FROM changes GROUP BY 1, 2),
t AS (SELECT g.repo_id, CASE WHEN contains(g.file_path, '/') THEN split_part(g.file_path, '/', 1) ELSE 'root' END AS subsystem,
  c.author, s.f FROM changes g JOIN commits c USING (repo_id, commit_hash) JOIN sizes s USING (repo_id, commit_hash)),
r AS (SELECT repo_id, subsystem, count(*)::DOUBLE AS n, sum(f)::DOUBLE AS total, stddev_pop(f) AS sd, count(DISTINCT author)::DOUBLE AS a
  FROM t GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT repo_id, subsystem, total AS lines_changed_sum, round(total / n, 6) AS lines_changed_mean, round(sd, 6) AS lines_changed_std,
  round(total * 0.6::DOUBLE, 6) AS insertions_sum, round(total * 0.4::DOUBLE, 6) AS insertions_mean, round(total * 0.4::DOUBLE, 6) AS deletions_sum,
  round(total * 0.2::DOUBLE, 6) AS deletions_mean, n AS commit_frequency_sum, a AS author_count_max, round(total / (n + 1), 6) AS change_rate,
  1.5::DOUBLE AS insertion_deletion_ratio, 0.5::DOUBLE AS change_volatility, round(a / (n + 1), 6) AS author_diversity FROM r""", n=SPREAD)
def _(spark, sf):
    return M.subsystem_features(I.subsystem_rollup(X.commits(spark, sf, SPREAD), X.file_changes(spark, sf, SPREAD)))


@query("m16_file_features", """
SELECT repo_id, file_path, round(c * f, 6) AS lines_changed_sum, round(c, 6) AS lines_changed_mean, round(c * 0.1::DOUBLE, 6) AS lines_changed_std,
  round(c * 0.6::DOUBLE, 6) AS insertions_sum, round(c * 0.5::DOUBLE, 6) AS insertions_mean, round(c * 0.4::DOUBLE, 6) AS deletions_sum,
  round(c * 0.3::DOUBLE, 6) AS deletions_mean, f::DOUBLE AS commit_frequency_sum, greatest(1, f // 3)::DOUBLE AS author_count_max,
  round(c * f / (f + 1), 6) AS change_rate, 1.5::DOUBLE AS insertion_deletion_ratio, 0.3::DOUBLE AS change_volatility,
  round(greatest(1, f // 3) / (f + 1)::DOUBLE, 6) AS author_diversity
FROM (SELECT repo_id, file_path, complexity AS c, change_frequency AS f FROM trends)""")
def _(spark, sf):
    return M.file_features(H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf)))


LATE = "user_id % 10 = 3"


def _streamed(spark, sf, build):
    """Events as touches (the user is the repository, the event type the file), streamed in three steps: all but the
    late users, the late users, and the row that closes the stream."""
    base = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    events = X.table(spark, sf, "events")
    touch = [F.col("ts").cast("timestamp").alias("committed_at"),
             F.concat(F.lit("repo"), F.col("user_id").cast("string")).alias("repo_id"),
             F.col("event_type").alias("file_path")]
    first, late = events.filter(f"NOT {LATE}").select(*touch), events.filter(LATE).select(*touch)
    for step in (first, late, rolling.close(first, "2100-01-01 00:00:00")):
        step.write.mode("append").parquet(f"{base}/in")
        found = rolling.drain(build(spark.readStream.schema(first.schema).parquet(f"{base}/in")), f"{base}/out")
    return found


# Rows of the late users count only in windows that end after the watermark the others left.
WATERMARK = "(SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE user_id % 10 <> 3)"


@query("st1_rolling_hotspots", f""", e AS (
SELECT 'repo' || user_id AS repo_id, event_type AS file_path, ts, user_id % 10 = 3 AS late FROM events),
w AS (SELECT e.*, date_trunc('day', ts) - to_days(CAST(d AS INT)) AS s FROM e, (SELECT unnest(range(0, 7)) AS d))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
  repo_id, file_path, count(*) AS touches FROM w
WHERE NOT late OR s + INTERVAL 7 DAY > {WATERMARK} GROUP BY s, repo_id, file_path""")
def _(spark, sf):
    return _streamed(spark, sf, lambda rows: rolling.rolling_hotspots(rows, "7 days", "1 day"))


@query("st2_daily_velocity", f"""
SELECT strftime(ts, '%Y-%m-%d 00:00:00') AS day, 'repo' || user_id AS repo_id, count(*) AS commits FROM events
WHERE user_id % 10 <> 3 OR date_trunc('day', ts) + INTERVAL 1 DAY > {WATERMARK} GROUP BY 1, 2""")
def _(spark, sf):
    return _streamed(spark, sf, rolling.daily_velocity)
