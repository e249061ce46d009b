"""Checked queries: stories, vectors and scalar functions."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import colors, dates, numbers as N, paths, rules, vectors
from ..operators import batch_model as B, similarity as S, stories as T
from ..operators.history import change_metrics
from ..operators.vector_index import build_index, search_index
from ..session import shared_folder
from . import workload as X
from .checks_graph import color_sql
from .checks_history import TYPED
from .registry import query

TYPE_CASE = """CASE WHEN contains(lower(message), 'add') OR contains(lower(message), 'feature') OR contains(lower(message), 'implement') THEN 'feature'
  WHEN contains(lower(message), 'fix') OR contains(lower(message), 'bug') OR contains(lower(message), 'issue') THEN 'bugfix'
  WHEN contains(lower(message), 'refactor') OR contains(lower(message), 'clean') OR contains(lower(message), 'restructure') THEN 'refactor'
  WHEN contains(lower(message), 'optimize') OR contains(lower(message), 'performance') OR contains(lower(message), 'speed') THEN 'performance'
  WHEN contains(lower(message), 'security') OR contains(lower(message), 'vulnerability') OR contains(lower(message), 'secure') THEN 'security'
  ELSE 'other' END"""
STORY = TYPED + f""", sums AS (
SELECT repo_id, commit_hash, CAST(sum(lines_added + lines_deleted) AS BIGINT) AS lines_changed,
       sum(complexity_after - complexity_before) AS complexity_delta, count(*) AS files_changed FROM modified GROUP BY 1, 2),
parts AS (SELECT repo_id, commit_hash, string_agg(c, ', ' ORDER BY c) AS names FROM (
  SELECT DISTINCT repo_id, commit_hash, split_part(file_path, '/', 2) AS c FROM modified WHERE contains(file_path, '/')) GROUP BY 1, 2),
told AS (SELECT c.repo_id, c.commit_hash, c.message, {TYPE_CASE} AS kind, c.message[1:100] AS summary,
       coalesce(p.names, '') AS names, coalesce(s.lines_changed, 0) AS l, coalesce(s.complexity_delta, 0.0) AS d,
       coalesce(s.files_changed, 0) AS n
  FROM commits c LEFT JOIN sums s USING (repo_id, commit_hash) LEFT JOIN parts p USING (repo_id, commit_hash)),
leveled AS (SELECT *, CASE WHEN l > 500 OR d > 20 OR n > 10 THEN 'high' WHEN l > 100 OR d > 5 OR n > 3 THEN 'medium' ELSE 'low' END AS level FROM told)"""
PURPOSE = """CASE kind
  WHEN 'feature' THEN 'This change introduces ' || summary || ' to ' || names || ', affecting the system''s functionality.'
  WHEN 'bugfix' THEN 'This fixes ' || summary || ' in ' || names || ' by implementing necessary corrections.'
  WHEN 'refactor' THEN 'This refactors ' || names || ' by ' || summary || ', improving code maintainability and readability.'
  WHEN 'performance' THEN 'This improves performance of ' || names || ' by ' || summary || ', resulting in better system performance.'
  WHEN 'security' THEN 'This enhances security by ' || summary || ' in ' || names || ', protecting against potential security vulnerabilities.'
  ELSE summary END"""
IMPACT_DESC = """CASE level
  WHEN 'high' THEN 'This change has significant system-wide impact, affecting multiple components and requiring careful testing and deployment.'
  WHEN 'medium' THEN 'This change has moderate impact on the system, affecting some key components but with manageable risk.'
  ELSE 'This change has minimal system impact, affecting isolated components with low risk of side effects.' END"""


@query("t1_commit_type", f"SELECT repo_id, commit_hash, {TYPE_CASE} AS kind FROM commits")
def _(spark, sf):
    return X.commits(spark, sf).select("repo_id", "commit_hash", rules.commit_type(F.col("message")).alias("kind"))


@query("t2_affected_components", STORY + "SELECT * FROM parts")
def _(spark, sf):
    rows = T.affected_components(change_metrics(X.gappy_file_changes(spark, sf)))
    return rows.select("repo_id", "commit_hash", F.array_join("components", ", ").alias("names"))


@query("t3_impact_totals", STORY + "SELECT * FROM sums")
def _(spark, sf):
    return T.impact_totals(change_metrics(X.gappy_file_changes(spark, sf)))


@query("t4_impact_level", STORY + """
SELECT s.repo_id, s.commit_hash, v.level FROM sums s JOIN leveled v USING (repo_id, commit_hash)""")
def _(spark, sf):
    rows = T.impact_totals(change_metrics(X.gappy_file_changes(spark, sf)))
    return rows.select("repo_id", "commit_hash", rules.impact_level(
        F.col("lines_changed"), F.col("complexity_delta"), F.col("files_changed")).alias("level"))


@query("t5_impact_description", STORY + f"""
SELECT s.repo_id, s.commit_hash, {IMPACT_DESC} AS text FROM sums s JOIN leveled v USING (repo_id, commit_hash)""")
def _(spark, sf):
    rows = T.impact_totals(change_metrics(X.gappy_file_changes(spark, sf)))
    level = rules.impact_level(F.col("lines_changed"), F.col("complexity_delta"), F.col("files_changed"))
    return rows.select("repo_id", "commit_hash", rules.impact_description(level).alias("text"))


@query("t6_purpose", STORY + f"SELECT repo_id, commit_hash, {PURPOSE} AS purpose FROM leveled")
def _(spark, sf):
    return T.commit_story(X.commits(spark, sf), X.gappy_file_changes(spark, sf)).select(
        "repo_id", "commit_hash", "purpose")


@query("t7_lead_summary", """
SELECT repo_id, file_path, regexp_replace(regexp_extract(content, '(?s)\\A(.*?)(?:\\n[ \\t]*\\n.*)?\\z', 1),
       '[ \\t\\r]*\\n[ \\t\\r]*', ' ', 'g') AS summary FROM files""", use="lines")
def _(spark, sf):
    return X.source_files(spark, sf).select("repo_id", "file_path", rules.lead_summary(F.col("content")).alias("summary"))


@query("t8_commit_story", STORY + f"""
SELECT repo_id, commit_hash, {PURPOSE} AS purpose, {IMPACT_DESC} AS system_impact, names FROM leveled""")
def _(spark, sf):
    rows = T.commit_story(X.commits(spark, sf), X.gappy_file_changes(spark, sf))
    return rows.withColumn("names", F.array_join("affected_components", ", ")).drop("affected_components")


@query("e1_importance_text", TYPED + """
SELECT c.repo_id, c.commit_hash, c.message || ' ' || coalesce(string_agg(m.change_type || ' in ' || m.file_path, ' '
       ORDER BY m.change_type || ' in ' || m.file_path), '') AS text
FROM commits c LEFT JOIN modified m USING (repo_id, commit_hash) GROUP BY c.repo_id, c.commit_hash, c.message""")
def _(spark, sf):
    return T.importance_texts(X.commits(spark, sf), X.gappy_file_changes(spark, sf))


VECTORS = """, v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"""


@query("e2_l2_norm", VECTORS + """
SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM v""")
def _(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", vectors.l2_norm(F.col("embedding")).alias("norm"))


@query("e3_cosine_similarity", VECTORS + """
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
FROM v a JOIN v b ON b.vec_id = a.vec_id * 7 % (SELECT count(*) FROM v)""")
def _(spark, sf):
    rows = X.table(spark, sf, "embeddings")
    size = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = rows.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") * 7 % size).alias("right_id"))
    return S.pair_similarity(pairs, rows)


def _centers(spark, sf):
    """Mean vector per label."""
    rows = X.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_v")).select(
        F.col("label").alias("probe_id"), F.transform("_v", lambda s: s["x"]).alias("embedding"))


@query("e4_most_similar", VECTORS + """, c AS (
SELECT label, list(x ORDER BY i) AS e FROM (
  SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT c.label::BIGINT AS probe_id, v.vec_id, list_cosine_similarity(c.e, v.e) AS similarity FROM c, v)
SELECT probe_id, vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, vec_id) AS rank
FROM s WHERE similarity >= 0.0 QUALIFY rank <= 5""")
def _(spark, sf):
    return S.most_similar(_centers(spark, sf), X.table(spark, sf, "embeddings"), k=5, threshold=0.0)


def _index(spark, sf):
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    build_index(X.table(spark, sf, "embeddings"), path)
    probes = X.table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe_id"), "embedding")
    return path, probes


TWENTIETH = VECTORS + """, p AS (
SELECT a.vec_id AS probe_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.vec_id % 20 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, vec_id) AS rank FROM p QUALIFY rank <= 10)"""


@query("e4_indexed_search", TWENTIETH + " SELECT probe_id, vec_id, round(similarity, 6) AS similarity, rank FROM best")
def _(spark, sf):
    """Every bucket visited: the index gives the exact result."""
    path, probes = _index(spark, sf)
    return search_index(spark, path, probes, share=1.0)


@query("e4_index_recall", TWENTIETH + " SELECT count(*) AS wanted, true AS enough FROM best")
def _(spark, sf):
    """The index at its own share of buckets against the exact form, over all rows."""
    path, probes = _index(spark, sf)
    exact = S.most_similar(probes, X.table(spark, sf, "embeddings"), k=10)
    hits = search_index(spark, path, probes).select("probe_id", "vec_id", F.lit(True).alias("_hit"))
    return exact.join(hits, ["probe_id", "vec_id"], "left").agg(
        F.count(F.lit(1)).alias("wanted"), (F.count("_hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("e5_embed_text", """
SELECT repo_id, file_path, CAST(len(string_split_regex(lower(content), '[ \\t\\n\\x0B\\f\\r]')) AS BIGINT) AS raw_tokens
FROM files""", use="lines")
def _(spark, sf):
    rows = S.importance(S.embed_text(X.source_files(spark, sf), "content"))
    # What SQL can state: the counts behind a vector add up to the text's tokens, trailing empty ones aside.
    trailing = F.size(F.split(F.lower("content"), r"\s", -1)) - F.size(F.split(F.lower("content"), r"\s", 0))
    return rows.select("repo_id", "file_path", (F.col("n_tokens") + trailing).cast("long").alias("raw_tokens"))


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
MODEL_VALUE = "CAST(sum((b * 31 + {0} * 17) % 101 - 50) AS DOUBLE) / count(*)"


@query("e5_model_vectors", f""", w AS (
SELECT doc_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '[^ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents),
b AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 4) AS INT) % 512 AS b FROM w),
v AS (SELECT doc_id, {", ".join(f"{MODEL_VALUE.format(j)} AS v{j}" for j in range(4))} FROM b GROUP BY 1)
SELECT doc_id, {", ".join(f"round(coalesce(v{j}, 0.0), 6) AS v{j}" for j in range(4))} FROM documents LEFT JOIN v USING (doc_id)""", use="lines")
def _(spark, sf):
    """A model of one table, stored, loaded and applied in batches; the table follows a rule that SQL can state."""
    b, j = np.arange(512)[:, None], np.arange(4)[None]
    path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    B.save_arrays(spark, {"rows": ((b * 31 + j * 17) % 101 - 50).astype(np.float64)}, path)
    found = B.model_vectors(X.table(spark, sf, "documents").select("doc_id", "text"), "text",
                            B.load_arrays(spark, path), B.mean_word_rows)
    return found.select("doc_id", *[F.get("embedding", F.lit(i)).alias(f"v{i}") for i in range(4)])


@query("f1_hsv_hex", f"SELECT repo_id, commit_hash, file_path, {color_sql('(lines % 101) / 100.0::DOUBLE')} AS color FROM changes")
def _(spark, sf):
    return X.file_changes(spark, sf).select("repo_id", "commit_hash", "file_path", colors.hsv_hex(
        (F.col("lines") % 101) / F.lit(100.0)).alias("color"))


@query("f2_health_color", f"SELECT repo_id, file_path, {color_sql('1 - (least(1.0::DOUBLE, change_frequency / 50.0::DOUBLE) * 0.4::DOUBLE + least(1.0::DOUBLE, complexity / 30.0::DOUBLE) * 0.6::DOUBLE)')} AS color FROM trends")
def _(spark, sf):
    from ..operators.history import complexity_trends
    rows = complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf))
    return rows.select("repo_id", "file_path", colors.health_color(
        F.col("change_frequency"), F.col("complexity")).alias("color"))


# Angles: checksum of the folder name, modulo 360.
@query("f3_path_position", """, p AS (
SELECT DISTINCT repo_id, file_path, len(string_split(file_path, '/')) AS depth,
       CASE WHEN contains(file_path, '/') THEN CASE split_part(file_path, '/', 2)
         WHEN 'api' THEN 79 WHEN 'svc' THEN 241 ELSE 155 END ELSE 0 END AS angle FROM changes)
SELECT repo_id, file_path, round(depth * 20 * cos(radians(angle)), 6) + 0.0 AS x, (depth * 10)::DOUBLE AS y,
       round(depth * 20 * sin(radians(angle)), 6) + 0.0 AS z FROM p""")
def _(spark, sf):
    rows = X.head_files(spark, sf).withColumn("p", colors.path_position(F.col("file_path")))
    return rows.select("repo_id", "file_path", "p.x", "p.y", "p.z")


@query("f4_node_color", f"SELECT repo_id, commit_hash, file_path, {color_sql('1 - ((insertions + deletions) / 400::DOUBLE * 0.5::DOUBLE + least(1.0::DOUBLE, lines * 5 / 1000.0::DOUBLE) * 0.5::DOUBLE)')} AS color FROM changes")
def _(spark, sf):
    return X.file_changes(spark, sf).select("repo_id", "commit_hash", "file_path", colors.node_color(
        F.col("insertions"), F.col("deletions"), F.col("lines") * 5, F.lit(400)).alias("color"))


@query("f5_basename", "SELECT DISTINCT repo_id, file_path, string_split(file_path, '/')[-1] AS name FROM changes")
def _(spark, sf):
    return X.head_files(spark, sf).select("repo_id", "file_path", paths.basename(F.col("file_path")).alias("name"))


@query("f6_ratios", """
SELECT repo_id, commit_hash, file_path, round(least(0.9, greatest(0.1, 1 - lines / 100.0::DOUBLE)), 6) AS clamped,
       round(least(1.0, lines / 50.0::DOUBLE), 6) AS capped,
       round(insertions / greatest(deletions - 5, 1)::DOUBLE, 6) AS guarded FROM changes""")
def _(spark, sf):
    i, d, n = F.col("insertions"), F.col("deletions"), F.col("lines")
    return X.file_changes(spark, sf).select(
        "repo_id", "commit_hash", "file_path", N.clamp(1 - n / F.lit(100.0), 0.1, 0.9).alias("clamped"),
        N.capped_ratio(n, 50).alias("capped"), N.guarded_ratio(i, d - 5).alias("guarded"))


@query("f7_line_count", "SELECT repo_id, file_path, len(a) AS n_lines FROM cut", use="lines")
def _(spark, sf):
    return X.source_files(spark, sf).select("repo_id", "file_path", paths.line_count(F.col("content")).alias("n_lines"))


@query("f8_epoch_to_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d 00:00:00') AS day FROM events""")
def _(spark, sf):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return X.table(spark, sf, "events").select("event_id", dates.epoch_to_date(seconds).alias("day"))


@query("f9_sunday_week", "SELECT repo_id, commit_hash, strftime(committed_at, '%Y-W%U') AS week FROM commits")
def _(spark, sf):
    return X.commits(spark, sf).select("repo_id", "commit_hash", dates.sunday_week(F.col("committed_at")).alias("week"))


@query("f10_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _(spark, sf):
    return X.table(spark, sf, "events").select("event_id", dates.iso_timestamp(F.col("ts").cast("timestamp")).alias("iso"))


ADDRESS = """CASE doc_id % 5 WHEN 0 THEN 'https://github.com/' || source || '/r' || doc_id
  WHEN 1 THEN 'HTTPS://GitHub.com/' || source || '/r' || doc_id || '.git'
  WHEN 2 THEN 'https://github.com/' || source || '/r' || doc_id || '/'
  WHEN 3 THEN 'https://github.com/' || source || '/r' || doc_id || '/tree' ELSE 'git@github.com:' || source || '/r' || doc_id END"""


@query("f11_parse_repo_url", f""", u AS (SELECT doc_id, {ADDRESS} AS url FROM documents),
m AS (SELECT doc_id, url, regexp_extract(regexp_replace(regexp_replace(url, '\\.git$', ''), '/$', ''),
      '(?i)^https://github\\.com/([^/]+)/([^/]+)$', ['owner', 'repo']) AS x FROM u)
SELECT doc_id, url, nullif(x.owner, '') AS owner, nullif(x.repo, '') AS repo FROM m""")
def _(spark, sf):
    rows = X.table(spark, sf, "documents").select("doc_id", F.expr(ADDRESS).alias("url"))
    found = rows.withColumn("x", paths.parse_repo_url(F.col("url")))
    return found.select("doc_id", "url", "x.owner", "x.repo")


@query("f12_score_band", """
SELECT repo_id, commit_hash, file_path, CASE WHEN lines >= 80 THEN 'good' WHEN lines >= 60 THEN 'warning' ELSE 'critical' END AS band,
       CASE WHEN lines >= 80 THEN 'green' WHEN lines >= 60 THEN 'yellow' ELSE 'red' END AS color FROM changes""")
def _(spark, sf):
    rows = X.file_changes(spark, sf).withColumn("b", N.score_band(F.col("lines")))
    return rows.select("repo_id", "commit_hash", "file_path", "b.band", "b.color")


@query("f13_py_round", "SELECT repo_id, commit_hash, file_path, (round_even((lines / 8.0::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE) AS rounded FROM changes")
def _(spark, sf):
    return X.file_changes(spark, sf).select("repo_id", "commit_hash", "file_path", N.py_round(
        F.col("lines") / F.lit(8.0), 2).alias("rounded"))
