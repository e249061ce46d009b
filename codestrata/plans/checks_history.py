"""Checked queries: predicates and commit history."""

from pyspark.sql import functions as F

from ..functions import paths, rules
from ..operators import history as H
from ..operators.grouping import newest_commits
from ..sources.exports import blob_at
from ..sources.schemas import CHANGE_METRICS, conform
from . import workload as X
from .registry import query, sql_time

TS = sql_time("committed_at")


def _trends(spark, sf):
    return H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf))


@query("p1_commit_history", f"""
SELECT repo_id, commit_hash, {TS} AS committed_at, author, message FROM commits c
WHERE committed_at >= TIMESTAMP '1995-01-01' AND committed_at <= TIMESTAMP '1997-12-31'
  AND EXISTS (SELECT 1 FROM changes f WHERE f.repo_id = c.repo_id AND f.commit_hash = c.commit_hash
              AND (f.file_path = 'core' OR f.file_path LIKE 'core/%'))""")
def _(spark, sf):
    return H.commit_history(X.commits(spark, sf), X.file_changes(spark, sf), "1995-01-01", "1997-12-31",
                            "core").select("repo_id", "commit_hash", "committed_at", "author", "message")


@query("p2_author_label", """
SELECT repo_id, commit_hash, author_name || ' <' || author_email || '>' AS label FROM commits""")
def _(spark, sf):
    return X.commits(spark, sf).select("repo_id", "commit_hash", rules.author_label(
        F.col("author_name"), F.col("author_email")).alias("label"))


@query("p3_source_files", """
SELECT repo_id, file_path, count(*) AS touches FROM changes
WHERE regexp_matches(file_path, '\\.(py|js|java|cpp|c|ts|rb|go)$') GROUP BY 1, 2""")
def _(spark, sf):
    return (X.file_changes(spark, sf).filter(paths.is_source(F.col("file_path")))
            .groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("touches")))


@query("p4_subsystem", """
SELECT repo_id, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'root' END AS subsystem,
       count(*) AS touches FROM changes GROUP BY 1, 2""")
def _(spark, sf):
    return (X.file_changes(spark, sf).groupBy("repo_id", paths.subsystem(F.col("file_path")).alias("subsystem"))
            .agg(F.count(F.lit(1)).alias("touches")))


@query("p5_refactor_commits", """
SELECT repo_id, commit_hash, message FROM commits WHERE contains(lower(message), 'refactor')""")
def _(spark, sf):
    return X.commits(spark, sf).filter(rules.mentions_refactor(F.col("message"))).select(
        "repo_id", "commit_hash", "message")


@query("p6_fix_commits", """
SELECT repo_id, commit_hash, message FROM commits WHERE contains(lower(message), 'fix')""")
def _(spark, sf):
    return X.commits(spark, sf).filter(rules.mentions_fix(F.col("message"))).select(
        "repo_id", "commit_hash", "message")


@query("p7_maintenance_commits", """
SELECT repo_id, commit_hash, message FROM commits
WHERE contains(lower(message), 'fix') OR contains(lower(message), 'bug')
   OR contains(lower(message), 'patch') OR contains(lower(message), 'repair')""")
def _(spark, sf):
    return X.commits(spark, sf).filter(rules.is_maintenance(F.col("message"))).select(
        "repo_id", "commit_hash", "message")


@query("p8_modified_files", """
SELECT repo_id, commit_hash, file_path FROM gappy
WHERE complexity_before IS NOT NULL AND complexity_after IS NOT NULL""")
def _(spark, sf):
    return H.change_metrics(X.gappy_file_changes(spark, sf)).select("repo_id", "commit_hash", "file_path")


@query("p9_busy_or_complex", """
SELECT repo_id, file_path, change_frequency, complexity FROM trends WHERE change_frequency > 10 OR complexity > 20""")
def _(spark, sf):
    rows = H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf))
    return rows.filter("change_frequency > 10 OR complexity > 20").select(
        "repo_id", "file_path", "change_frequency", "complexity")


@query("s5_blob_at", f"""
SELECT 'repo' || (o_custkey % 50) AS repo_id, o_orderkey AS commit_hash, 'pkg/main.py' AS file_path,
       CAST(length('def run(a, b):' || chr(10) || repeat('    if a > b:' || chr(10) || '        a -= 1' || chr(10),
            CAST(o_orderkey % 23 AS INT)) || '    return a' || chr(10)) AS BIGINT) AS n_chars
FROM orders WHERE o_orderkey % 13 <> 0""")
def _(spark, sf):
    return blob_at(X.commits(spark, sf), X.blobs(spark, sf)).select(
        "repo_id", "commit_hash", "file_path", F.length("content").alias("n_chars"))


@query("k4_conform", """
SELECT repo_id, CAST(commit_hash AS VARCHAR) AS commit_hash, file_path, insertions AS lines_added,
       deletions AS lines_deleted, complexity_before, complexity_after,
       CASE WHEN insertions <> 0 AND deletions <> 0 AND insertions / deletions >= 0.7 AND insertions / deletions <= 1.3
            THEN 'refactor' ELSE 'modification' END AS change_type
FROM gappy WHERE complexity_before IS NOT NULL AND complexity_after IS NOT NULL""")
def _(spark, sf):
    return conform(H.change_metrics(X.gappy_file_changes(spark, sf)), CHANGE_METRICS)


@query("a1_with_parent", f"""
SELECT c.repo_id, c.commit_hash, c.parent_hash, {sql_time('p.committed_at')} AS parent_committed_at,
       p.author AS parent_author
FROM commits c LEFT JOIN commits p ON p.repo_id = c.repo_id AND p.commit_hash = c.parent_hash""")
def _(spark, sf):
    return H.with_parent(X.commits(spark, sf, parents=True)).select(
        "repo_id", "commit_hash", "parent_hash", "parent_committed_at", "parent_author")


TYPED = """, typed AS (
SELECT repo_id, commit_hash, file_path, insertions AS lines_added, deletions AS lines_deleted,
       complexity_before, complexity_after,
       CASE WHEN complexity_before IS NULL THEN 'addition' WHEN complexity_after IS NULL THEN 'deletion'
            WHEN insertions <> 0 AND deletions <> 0 AND CAST(insertions AS DOUBLE) / deletions BETWEEN 0.7 AND 1.3
            THEN 'refactor' ELSE 'modification' END AS change_type
FROM gappy), modified AS (
SELECT * FROM typed WHERE complexity_before IS NOT NULL AND complexity_after IS NOT NULL)"""


@query("a2_change_metrics", TYPED + " SELECT * FROM modified")
def _(spark, sf):
    return H.change_metrics(X.gappy_file_changes(spark, sf))


@query("a3_change_type", TYPED + " SELECT repo_id, change_type, count(*) AS n FROM typed GROUP BY 1, 2")
def _(spark, sf):
    rows = H.change_metrics(X.gappy_file_changes(spark, sf), modified_only=False)
    return rows.groupBy("repo_id", "change_type").agg(F.count(F.lit(1)).alias("n"))


@query("a4_complexity_delta", "SELECT * FROM deltas")
def _(spark, sf):
    return H.complexity_delta(X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf))


FOUND = """, found AS (
SELECT * FROM (SELECT *, CASE
    WHEN contains(lower(message), 'extract') OR contains(lower(message), 'split') THEN 'extract_method'
    WHEN contains(lower(message), 'rename') THEN 'rename' WHEN contains(lower(message), 'move') THEN 'move'
    WHEN contains(lower(message), 'inline') THEN 'inline' END AS pattern
  FROM commits WHERE contains(lower(message), 'refactor')) WHERE pattern IS NOT NULL)"""
IMPACT = """, impact AS (
SELECT g.repo_id, g.commit_hash, g.file_path, c.committed_at,
       0.4 * (g.insertions + g.deletions) + 0.3 * abs(d.complexity_delta)
       + 0.3 * coalesce(i.importance, 0.0) AS impact
FROM gappy g JOIN commits c USING (repo_id, commit_hash) JOIN deltas d USING (repo_id, commit_hash)
LEFT JOIN importance i USING (repo_id, commit_hash))"""


@query("a5_refactoring_patterns", FOUND + f""", hit AS (
SELECT f.repo_id, f.commit_hash, f.pattern, {sql_time('f.committed_at')} AS committed_at, f.message,
       coalesce((SELECT string_agg(g.file_path, '|' ORDER BY g.file_path) FROM changes g
                 WHERE g.repo_id = f.repo_id AND g.commit_hash = f.commit_hash), '') AS files
FROM found f WHERE f.committed_at >= TIMESTAMP '1995-01-01' AND f.committed_at <= TIMESTAMP '1996-12-31')
SELECT * FROM hit UNION ALL
SELECT r.repo_id, NULL, p.pattern, NULL, NULL, NULL
FROM (SELECT DISTINCT repo_id FROM commits) r,
     (SELECT unnest(['extract_method', 'rename', 'move', 'inline']) AS pattern) p
WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.repo_id = r.repo_id AND h.pattern = p.pattern)""")
def _(spark, sf):
    rows = H.refactoring_patterns(X.commits(spark, sf), X.file_changes(spark, sf), "1995-01-01", "1996-12-31")
    return rows.select("repo_id", "commit_hash", "pattern", "committed_at", "message",
                       F.array_join("files", "|").alias("files"))


@query("a6_pattern_summary", FOUND + IMPACT + """
SELECT f.repo_id, f.pattern, count(DISTINCT f.commit_hash) AS frequency,
       count(DISTINCT i.file_path) AS n_affected_files, round(coalesce(sum(i.impact), 0.0), 6) AS impact_score
FROM found f LEFT JOIN impact i USING (repo_id, commit_hash) GROUP BY 1, 2""")
def _(spark, sf):
    c, g = X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf)
    return H.pattern_summary(c, g, H.touch_impact(c, g, X.importance(spark, sf)))


@query("a6_pattern_files", FOUND + """
SELECT DISTINCT f.repo_id, f.pattern, g.file_path FROM found f JOIN changes g USING (repo_id, commit_hash)""")
def _(spark, sf):
    return H.pattern_files(X.commits(spark, sf), X.file_changes(spark, sf))


@query("a7_hotspots", IMPACT + f"""
SELECT repo_id, file_path, count(*) AS change_count, round(sum(impact), 6) AS impact_score,
       {sql_time('max(committed_at)')} AS last_modified FROM impact GROUP BY 1, 2""")
def _(spark, sf):
    return H.hotspots(X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf), X.importance(spark, sf))


@query("a7_hotspots_timeframe", IMPACT + f"""
SELECT repo_id, file_path, count(*) AS change_count, round(sum(impact), 6) AS impact_score,
       {sql_time('max(committed_at)')} AS last_modified FROM impact
WHERE committed_at > TIMESTAMP '1997-06-30' - INTERVAL 18 MONTH AND committed_at <= TIMESTAMP '1997-06-30' GROUP BY 1, 2""")
def _(spark, sf):
    return H.hotspots(X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf), X.importance(spark, sf),
                      "18m", "1997-06-30")


@query("a8_change_impact", IMPACT + """
SELECT repo_id, commit_hash, file_path, round(impact, 6) AS impact FROM impact""")
def _(spark, sf):
    return H.touch_impact(X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf),
                          X.importance(spark, sf)).select("repo_id", "commit_hash", "file_path", "impact")


@query("a9_complexity_trend", f"""
SELECT g.repo_id, g.file_path, {sql_time('c.committed_at')} AS timestamp, g.complexity_after AS complexity, g.commit_hash
FROM gappy g JOIN commits c USING (repo_id, commit_hash)
WHERE g.complexity_after IS NOT NULL AND c.committed_at >= TIMESTAMP '1994-01-01'
  AND c.committed_at <= TIMESTAMP '1998-06-30'""")
def _(spark, sf):
    return H.complexity_trend(X.commits(spark, sf), X.gappy_file_changes(spark, sf),
                              start="1994-01-01", end="1998-06-30")


@query("a10_commit_statistics", """
SELECT c.repo_id, c.commit_hash, CAST(epoch(c.committed_at) AS BIGINT) AS timestamp, c.author, c.message,
       coalesce(string_agg(g.file_path, '|' ORDER BY g.file_path), '') AS files
FROM commits c LEFT JOIN changes g USING (repo_id, commit_hash) GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    rows = H.commit_statistics(X.commits(spark, sf), X.file_changes(spark, sf))
    return rows.select("repo_id", "commit_hash", "timestamp", "author", "message",
                       F.array_join("files", "|").alias("files"))


@query("a11_repo_statistics", "SELECT repo_id, count(DISTINCT file_path) AS total_files FROM changes GROUP BY 1")
def _(spark, sf):
    return H.repo_statistics(X.commits(spark, sf), _trends(spark, sf), X.head_files(spark, sf))


@query("a11_newest_commit_files", """
SELECT r.repo_id, count(f.file_path) AS total_files
FROM recent r LEFT JOIN changes f USING (repo_id, commit_hash) WHERE r.rn = 1 GROUP BY 1""")
def _(spark, sf):
    return H.repo_statistics(X.commits(spark, sf), _trends(spark, sf), None)


@query("a12_complexity_trends", "SELECT * FROM trends")
def _(spark, sf):
    return H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf))


@query("a12_complexity_trends_newest", """
SELECT g.repo_id, g.file_path,
       coalesce(min_by(g.complexity_after, r.rn) FILTER (WHERE g.complexity_after IS NOT NULL), 0.0) AS complexity,
       count(*) AS change_frequency, min(r.rn) AS first_seen
FROM gappy g JOIN recent r USING (repo_id, commit_hash) WHERE r.rn <= 100 GROUP BY 1, 2""")
def _(spark, sf):
    return H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf), 100, "newest")


@query("a12_newest_commits", "SELECT repo_id, commit_hash, rn FROM recent")
def _(spark, sf):
    return newest_commits(X.commits(spark, sf), 200).select("repo_id", "commit_hash", "rn")


@query("a13_timeline", TYPED + f"""
SELECT c.repo_id, {sql_time('c.committed_at')} AS timestamp, c.commit_hash, c.author, c.message,
       coalesce(m.changes, '') AS changes, d.complexity_delta, round(coalesce(i.importance, 0.0), 6) AS semantic_importance
FROM commits c JOIN deltas d USING (repo_id, commit_hash)
LEFT JOIN importance i USING (repo_id, commit_hash)
LEFT JOIN (SELECT repo_id, commit_hash, string_agg(file_path || ':' || lines_added || ':' || lines_deleted || ':' || change_type,
                  '|' ORDER BY file_path) AS changes FROM modified GROUP BY 1, 2) m USING (repo_id, commit_hash)""")
def _(spark, sf):
    rows = H.timeline(X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf), X.importance(spark, sf))
    text = F.transform("changes", lambda c: F.concat_ws(
        ":", c["file_path"], c["lines_added"].cast("string"), c["lines_deleted"].cast("string"), c["change_type"]))
    return rows.withColumn("changes", F.array_join(text, "|"))


@query("a13_timeline_rows", TYPED + f"""
SELECT c.repo_id, c.commit_hash, {sql_time('c.committed_at')} AS committed_at, c.author, c.message, d.complexity_delta,
       m.file_path, m.lines_added, m.lines_deleted, m.complexity_before, m.complexity_after, m.change_type
FROM commits c JOIN deltas d USING (repo_id, commit_hash) LEFT JOIN modified m USING (repo_id, commit_hash)
WHERE c.committed_at >= TIMESTAMP '1996-01-01' AND EXISTS (
  SELECT 1 FROM gappy f WHERE f.repo_id = c.repo_id AND f.commit_hash = c.commit_hash
  AND (f.file_path = 'ui/util' OR f.file_path LIKE 'ui/util/%'))""")
def _(spark, sf):
    return H.timeline_rows(X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf),
                           start="1996-01-01", path="ui/util/")


@query("a14_commit_frequency", "SELECT repo_id, file_path, count(*) AS frequency FROM changes GROUP BY 1, 2")
def _(spark, sf):
    return H.commit_frequency(X.file_changes(spark, sf))


@query("a15_last_modified", """
SELECT f.repo_id, f.file_path, strftime(max(c.committed_at), '%Y-%m-%dT%H:%M:%S') AS last_modified
FROM changes f JOIN commits c USING (repo_id, commit_hash) GROUP BY 1, 2""")
def _(spark, sf):
    return H.last_modified(X.commits(spark, sf), X.file_changes(spark, sf))


@query("a16_hotspot_metrics", f""", touched AS (
SELECT g.*, c.committed_at, c.author FROM gappy g JOIN commits c USING (repo_id, commit_hash)),
days AS (SELECT repo_id, file_path, CAST(committed_at AS DATE) AS day, avg(complexity_after) AS mean
         FROM touched WHERE complexity_after IS NOT NULL GROUP BY 1, 2, 3),
curve AS (SELECT repo_id, file_path, count(*) AS n_days, round(sum(mean), 6) AS day_sum,
                 round(max_by(mean, day), 6) AS last_mean FROM days GROUP BY 1, 2)
SELECT t.repo_id, t.file_path, t.change_frequency, t.last_modified, coalesce(v.n_days, -1) AS n_days,
       v.day_sum, v.last_mean, round(CASE WHEN r.complexity IS NULL THEN 0.0
            ELSE 0.4 * least(r.complexity / 30, 1.0) + 0.6 * least(r.change_frequency / 15, 1.0) END, 6) AS risk_score,
       t.contributors
FROM (SELECT repo_id, file_path, count(*) AS change_frequency, {sql_time('max(committed_at)')} AS last_modified,
             string_agg(DISTINCT author, '|' ORDER BY author) AS contributors FROM touched GROUP BY 1, 2) t
LEFT JOIN curve v USING (repo_id, file_path) LEFT JOIN trends r USING (repo_id, file_path)""")
def _(spark, sf):
    c, g = X.commits(spark, sf), X.gappy_file_changes(spark, sf)
    rows = H.hotspot_metrics(c, g, H.complexity_trends(c, g))
    curve = F.col("complexity_trend")
    return rows.select(
        "repo_id", "file_path", "change_frequency", "last_modified",
        F.coalesce(F.size(curve), F.lit(-1)).alias("n_days"),
        F.aggregate(curve, F.lit(0.0), lambda a, x: a + x).alias("day_sum"),
        F.element_at(curve, -1).alias("last_mean"), "risk_score", F.array_join("contributors", "|").alias("contributors"))


@query("a18_commit_analysis", TYPED + f"""
SELECT c.repo_id, c.commit_hash, {sql_time('c.committed_at')} AS timestamp, d.complexity_delta AS complexity_impact,
       coalesce(m.n, 0) AS n_changes
FROM commits c JOIN deltas d USING (repo_id, commit_hash)
LEFT JOIN (SELECT repo_id, commit_hash, count(*) AS n FROM modified GROUP BY 1, 2) m USING (repo_id, commit_hash)""")
def _(spark, sf):
    rows = H.commit_analysis(H.timeline(X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf)))
    return rows.select("repo_id", "commit_hash", "timestamp", "complexity_impact", F.size("changes").alias("n_changes"))
