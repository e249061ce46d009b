"""Checked queries: insight scores, rules, forecasts and the dashboard."""

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as N, rules
from ..operators import history as H, insights as I
from ..session import shared_folder
from ..sources.sinks import pretty_json, write_insights
from . import workload as X
from .dashboard import dashboard, insights_document
from .registry import query, sql_time

AS_OF = "2024-06-01 00:00:00"
SPREAD = 1500  # repositories in the finer mapping


def _trends(spark, sf):
    return H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf))


def _rollup(spark, sf, **options):
    return I.subsystem_rollup(X.commits(spark, sf, SPREAD), X.file_changes(spark, sf, SPREAD), **options)


ROLLUP = """, sizes AS (SELECT repo_id, commit_hash, count(*) AS n_files FROM changes GROUP BY 1, 2),
touches AS (
  SELECT f.repo_id, CASE WHEN contains(f.file_path, '/') THEN split_part(f.file_path, '/', 1) ELSE 'root' END AS subsystem,
         c.committed_at, c.commit_hash, c.author, c.message, s.n_files
  FROM changes f JOIN commits c USING (repo_id, commit_hash) JOIN sizes s USING (repo_id, commit_hash)),
rollup_ AS (
  SELECT repo_id, subsystem, count(*) AS n, count(*) / 30.0::DOUBLE AS frequency,
         count(*) FILTER (WHERE contains(lower(message), 'fix')) AS bug_fixes,
         count(DISTINCT author) AS authors, CAST(sum(n_files) AS BIGINT) AS total_files,
         avg(n_files) AS mean_files, stddev_pop(n_files) AS std_files,
         max_by(n_files, (committed_at, commit_hash)) AS newest_files,
         min_by(n_files, (committed_at, commit_hash)) AS oldest_files
  FROM touches GROUP BY 1, 2 HAVING count(*) >= 5),
scored AS (
  SELECT *, 0.4 * least(n / 20.0::DOUBLE, 1.0) + 0.3 * least(authors / 5.0::DOUBLE, 1.0)
            + 0.3 * least(mean_files / 10.0::DOUBLE, 1.0) AS score FROM rollup_)"""
TREND_CASE = """CASE WHEN {a} > {b} * 1.2 THEN 'increasing' WHEN {a} < {b} * 0.8 THEN 'decreasing' ELSE 'stable' END"""
STATUS_CASE = """CASE WHEN score > 0.7 THEN 'critical' WHEN score > 0.5 THEN 'warning'
  WHEN frequency > 5 AND bug_fixes < n * 0.1 THEN 'healthy' ELSE 'stable' END"""


@query("i1_subsystem_rollup", ROLLUP + """
SELECT repo_id, subsystem, n, round(frequency, 6) AS frequency, bug_fixes, authors, total_files,
       round(mean_files, 6) AS mean_files, round(std_files, 6) AS std_files, newest_files, oldest_files
FROM rollup_""", n=SPREAD)
def _(spark, sf):
    return _rollup(spark, sf)


@query("i1_subsystem_rollup_by_commit", ROLLUP + """, once AS (
SELECT DISTINCT repo_id, subsystem, committed_at, commit_hash, author, message, n_files FROM touches)
SELECT repo_id, subsystem, count(*) AS n, CAST(sum(n_files) AS BIGINT) AS total_files,
       count(*) FILTER (WHERE contains(lower(message), 'fix')) AS bug_fixes
FROM once GROUP BY 1, 2 HAVING count(*) >= 3""", n=SPREAD)
def _(spark, sf):
    return _rollup(spark, sf, min_touches=3, unit="commit").select(
        "repo_id", "subsystem", "n", "total_files", "bug_fixes")


@query("i2_subsystem_hotspot_score", ROLLUP + "SELECT repo_id, subsystem, round(score, 6) AS score FROM scored", n=SPREAD)
def _(spark, sf):
    return _rollup(spark, sf).select("repo_id", "subsystem", N.subsystem_hotspot_score(
        F.col("n"), F.col("authors"), F.col("mean_files")).alias("score"))


@query("i3_subsystem_trend", ROLLUP + f"""
SELECT repo_id, subsystem, {TREND_CASE.format(a='oldest_files', b='newest_files')} AS literal,
       {TREND_CASE.format(a='newest_files', b='oldest_files')} AS corrected FROM scored""", n=SPREAD)
def _(spark, sf):
    return _rollup(spark, sf).select("repo_id", "subsystem", I.subsystem_trend().alias("literal"),
                                     I.subsystem_trend("corrected").alias("corrected"))


@query("i4_subsystem_health", ROLLUP + f"""
SELECT repo_id, subsystem AS name, {STATUS_CASE} AS status,
       {TREND_CASE.format(a='oldest_files', b='newest_files')} AS complexity_trend,
       '{AS_OF}' AS last_updated, round(score, 6) AS score FROM scored""", n=SPREAD)
def _(spark, sf):
    return I.subsystem_health(_rollup(spark, sf), F.lit(AS_OF).cast("timestamp"))


SCORES = """, s AS (
SELECT *, (least(complexity / 50, 1.0) + least(change_frequency / 20.0::DOUBLE, 1.0)) / 2 AS score,
       0.4 * least(complexity / 30, 1.0) + 0.6 * least(change_frequency / 15.0::DOUBLE, 1.0) AS risk
FROM trends)"""
REASON = """coalesce(nullif(concat_ws('; ',
  CASE WHEN score > 0.7 THEN 'High change frequency indicates instability' END,
  CASE WHEN complexity > 20 THEN 'High complexity score suggests need for simplification' END,
  CASE WHEN change_frequency > 10 THEN 'Frequent modifications suggest poor design' END), ''),
  'Code quality improvement opportunity')"""
ACTION = """CASE WHEN score > 0.8 AND complexity > 25 THEN 'Consider major restructuring or decomposition'
  WHEN score > 0.6 THEN 'Implement design patterns to reduce coupling'
  WHEN complexity > 15 THEN 'Extract methods and simplify logic' ELSE 'Apply minor refactoring improvements' END"""
EFFORT = "CASE WHEN complexity > 30 THEN 'high' WHEN complexity > 15 THEN 'medium' ELSE 'low' END"
RISK_IMPACT = """CASE WHEN complexity > 25 AND change_frequency > 15 THEN 'High impact on system stability and development velocity'
  WHEN complexity > 15 OR change_frequency > 10 THEN 'Moderate impact on maintainability'
  ELSE 'Low impact but worth monitoring' END"""
MITIGATION = """CASE WHEN risk > 0.8 THEN 'Prioritize refactoring and add comprehensive tests'
  WHEN risk > 0.6 THEN 'Implement monitoring and gradual improvement'
  ELSE 'Regular code reviews and documentation' END"""
ALERTS = SCORES + f""", alerts AS (
SELECT repo_id, file_path, {REASON} AS reason,
       CASE WHEN score > 0.8 OR complexity > 30 THEN 'high' ELSE 'medium' END AS severity,
       {ACTION} AS suggested_action, {EFFORT} AS estimated_effort,
       row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN score > 0.8 OR complexity > 30 THEN 0 ELSE 1 END,
                          file_path) AS rank
FROM s WHERE score > 0.6 OR complexity > 20 OR change_frequency > 10 QUALIFY rank <= 10),
risks AS (
SELECT repo_id, file_path AS area_name, CASE WHEN risk > 0.8 THEN 'high' ELSE 'medium' END AS risk_level,
       {RISK_IMPACT} AS potential_impact, {MITIGATION} AS mitigation_strategy, first_seen,
       row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN risk > 0.8 THEN 0 ELSE 1 END, first_seen,
                          file_path) AS rank
FROM s WHERE risk > 0.5 QUALIFY rank <= 10)"""


@query("i5_file_hotspot_score", SCORES + "SELECT repo_id, file_path, round(score, 6) AS score FROM s")
def _(spark, sf):
    return I.with_file_scores(_trends(spark, sf)).select("repo_id", "file_path", "score")


@query("i6_refactor_alerts", ALERTS + "SELECT * FROM alerts")
def _(spark, sf):
    return I.refactor_alerts(_trends(spark, sf))


@query("i7_file_risk_score", SCORES + "SELECT repo_id, file_path, round(risk, 6) AS risk FROM s")
def _(spark, sf):
    return _trends(spark, sf).select("repo_id", "file_path", N.file_risk_score(
        F.col("complexity"), F.col("change_frequency")).alias("risk"))


@query("i8_risk_areas", ALERTS + "SELECT * FROM risks")
def _(spark, sf):
    return I.risk_areas(_trends(spark, sf))


def _text_query(name, sql_expression, expression):
    @query(name, SCORES + f"SELECT repo_id, file_path, {sql_expression} AS text FROM s")
    def _(spark, sf):
        rows = I.with_file_scores(_trends(spark, sf)).withColumn(
            "risk", N.file_risk_score(F.col("complexity"), F.col("change_frequency")))
        return rows.select("repo_id", "file_path", expression(
            F.col("score"), F.col("complexity"), F.col("change_frequency"), F.col("risk")).alias("text"))


_text_query("i10_refactor_reason", REASON, lambda s, c, f, r: rules.refactor_reason(s, c, f))
_text_query("i11_refactor_action", ACTION, lambda s, c, f, r: rules.refactor_action(s, c))
_text_query("i12_refactor_effort", EFFORT, lambda s, c, f, r: rules.refactor_effort(c))
_text_query("i13_risk_impact", RISK_IMPACT, lambda s, c, f, r: rules.risk_impact(c, f))
_text_query("i14_mitigation", MITIGATION, lambda s, c, f, r: rules.mitigation(r))


TOTALS = """, totals AS (
SELECT c.*, t.mean_complexity, coalesce(t.over_15, 0) AS over_15, coalesce(t.over_20, 0) AS over_20
FROM (SELECT repo_id, count(*) AS total_commits,
             count(*) FILTER (WHERE contains(lower(message), 'fix') OR contains(lower(message), 'bug')
               OR contains(lower(message), 'patch') OR contains(lower(message), 'repair')) AS maintenance
      FROM commits GROUP BY 1) c
LEFT JOIN (SELECT repo_id, avg(complexity) AS mean_complexity, count(*) FILTER (WHERE complexity > 15) AS over_15,
                  count(*) FILTER (WHERE complexity > 20) AS over_20 FROM trends GROUP BY 1) t USING (repo_id)),
upkeep AS (
SELECT repo_id, unnest([
  {'t': 'bug_fixes', 'f': greatest(1, CAST(trunc(total_commits * (maintenance / total_commits::DOUBLE) * 0.1) AS BIGINT)), 'c': 0.7::DOUBLE},
  {'t': 'refactoring', 'f': greatest(1, CAST(trunc(over_20 * 0.2) AS BIGINT)), 'c': 0.6::DOUBLE},
  {'t': 'documentation', 'f': greatest(1, CAST(trunc(total_commits * 0.05) AS BIGINT)), 'c': 0.8::DOUBLE}]) AS x
FROM totals),
metrics AS (
SELECT t.repo_id, h.total_files, t.total_commits, (round_even((mean_complexity) * 100.0::DOUBLE, 0) / 100.0::DOUBLE) AS average_complexity,
       (round_even((over_15 / h.total_files::DOUBLE) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS technical_debt_ratio,
       (round_even((greatest(0.0, 100 - (over_15 / h.total_files::DOUBLE) * 50 - mean_complexity * 2)) * 10.0::DOUBLE, 0) / 10.0::DOUBLE) AS code_quality_score,
       round(h.touches / t.total_commits::DOUBLE, 6) AS average_files_per_commit
FROM totals t JOIN (SELECT repo_id, count(DISTINCT file_path) AS total_files, count(*) AS touches
                    FROM changes GROUP BY 1) h USING (repo_id))"""


@query("i9_maintenance_forecast", TOTALS + """
SELECT repo_id, x.t AS maintenance_type, x.f AS predicted_frequency, '30_days' AS timeframe, x.c AS confidence_score FROM upkeep""")
def _(spark, sf):
    return I.maintenance_forecast(I.repo_totals(X.commits(spark, sf), _trends(spark, sf)))


@query("i15_codebase_metrics", TOTALS + f"SELECT * EXCLUDE (average_files_per_commit), '{AS_OF}' AS last_analyzed FROM metrics")
def _(spark, sf):
    return I.codebase_metrics(X.commits(spark, sf), _trends(spark, sf), X.head_files(spark, sf),
                              F.lit(AS_OF).cast("timestamp"))


@query("i16_average_files_per_commit", TOTALS + "SELECT repo_id, average_files_per_commit FROM metrics")
def _(spark, sf):
    return I.average_files_per_commit(X.commits(spark, sf), X.file_changes(spark, sf))


@query("i17_commits_per_day", """
SELECT repo_id, strftime(committed_at, '%Y-%m-%d 00:00:00') AS day, count(*) AS commits FROM commits GROUP BY 1, 2""")
def _(spark, sf):
    return I.commits_per_day(X.commits(spark, sf))


FORECAST = """, days AS (
SELECT repo_id, CAST(committed_at AS DATE) AS day, count(*) AS commits,
       row_number() OVER (PARTITION BY repo_id ORDER BY CAST(committed_at AS DATE) DESC) AS rn
FROM commits GROUP BY 1, 2),
base AS (SELECT repo_id, count(*) FILTER (WHERE rn <= 14) AS n_days,
                CAST(coalesce(sum(commits) FILTER (WHERE rn <= 7), 0) AS BIGINT) AS r,
                CAST(coalesce(sum(commits) FILTER (WHERE rn > 7 AND rn <= 14), 0) AS BIGINT) AS p FROM days GROUP BY 1),
grown AS (SELECT *, (r - p) / greatest(p, 1)::DOUBLE AS g FROM base),
fast AS (SELECT *, r * (1 + g) AS v FROM grown),
outlook AS (
SELECT repo_id, 'development_velocity' AS resource_type, CAST(10 AS BIGINT) AS predicted_need, 0.5::DOUBLE AS confidence_score FROM fast WHERE n_days < 7
UNION ALL SELECT repo_id, 'development_velocity', greatest(1, CAST(trunc(v) AS BIGINT)), round(least(0.9, greatest(0.1, 1 - abs(g))), 6) FROM fast WHERE n_days >= 7
UNION ALL SELECT repo_id, 'code_review_capacity', greatest(1, CAST(trunc(v * 0.3) AS BIGINT)), 0.7 FROM fast WHERE n_days >= 7
UNION ALL SELECT repo_id, 'testing_effort', greatest(1, CAST(trunc(v * 0.5) AS BIGINT)), 0.6 FROM fast WHERE n_days >= 7)"""


@query("i18_resource_forecast", FORECAST + "SELECT *, '7_days' AS timeframe FROM outlook", n=SPREAD)
def _(spark, sf):
    return I.resource_forecast(X.commits(spark, sf, SPREAD))


@query("i19_complexity_forecast", TOTALS + """
SELECT repo_id, 'overall' AS component, (round_even((coalesce(mean_complexity, 10.0)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE) AS predicted_complexity,
       'stable' AS trend, 0.6::DOUBLE AS confidence_score FROM totals""")
def _(spark, sf):
    return I.complexity_forecast(I.repo_totals(X.commits(spark, sf), _trends(spark, sf)))


@query("i19_weekly_complexity_forecast", """, weeks AS (
SELECT g.repo_id, strftime(c.committed_at, '%Y-W%U') AS week, avg(g.complexity_after) AS mean
FROM gappy g JOIN commits c USING (repo_id, commit_hash) WHERE g.complexity_after IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT repo_id, count(*) AS n, max_by(mean, week) AS b, min_by(mean, week) AS a FROM weeks GROUP BY 1)
SELECT repo_id, 'overall' AS component, (round_even((CASE WHEN n >= 2 THEN b * 1.05 ELSE b END) * 100.0::DOUBLE, 0) / 100.0::DOUBLE) AS predicted_complexity,
       CASE WHEN n >= 2 AND b > a THEN 'increasing' ELSE 'stable' END AS trend, 0.6::DOUBLE AS confidence_score FROM ends""")
def _(spark, sf):
    return I.weekly_complexity_forecast(X.commits(spark, sf), X.gappy_file_changes(spark, sf))


def _dashboard(spark, sf):
    return dashboard(X.commits(spark, sf), X.gappy_file_changes(spark, sf), X.head_files(spark, sf),
                     F.lit(AS_OF).cast("timestamp"))


def _joined(array, *fields):
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "|")


DASHBOARD = (ROLLUP + ALERTS + TOTALS + FORECAST + f"""
SELECT m.repo_id, coalesce(h.t, '') AS subsystem_health, coalesce(a.t, '') AS refactor_alerts,
       m.total_files, m.total_commits, m.average_complexity, m.technical_debt_ratio, m.code_quality_score,
       coalesce(r.t, '') AS risk_areas, u.t AS maintenance, f.t AS resources,
       'overall:stable:0.6' AS outlook_text, p.predicted_complexity AS outlook, '{AS_OF}' AS generated_at
FROM metrics m
LEFT JOIN (SELECT repo_id, string_agg(subsystem || ':' || {STATUS_CASE} || ':' ||
             {TREND_CASE.format(a='oldest_files', b='newest_files')}, '|' ORDER BY subsystem) AS t FROM scored GROUP BY 1) h USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(rank || ':' || file_path || ':' || severity, '|' ORDER BY rank) AS t FROM alerts GROUP BY 1) a USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(rank || ':' || area_name || ':' || risk_level, '|' ORDER BY rank) AS t FROM risks GROUP BY 1) r USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(x.t || ':' || x.f, '|' ORDER BY x.t) AS t FROM upkeep GROUP BY 1) u USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(resource_type || ':' || predicted_need, '|' ORDER BY resource_type) AS t FROM outlook GROUP BY 1) f USING (repo_id)
JOIN (SELECT repo_id, round_even(coalesce(mean_complexity, 10.0) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS predicted_complexity
      FROM totals) p USING (repo_id)""")


def _flat(rows):
    m, outlook = F.col("codebase_metrics"), F.col("complexity_predictions")
    return rows.select(
        "repo_id", _joined("subsystem_health", "name", "status", "complexity_trend").alias("subsystem_health"),
        _joined("refactor_alerts", "rank", "file_path", "severity").alias("refactor_alerts"),
        *[m[c].alias(c) for c in ("total_files", "total_commits", "average_complexity", "technical_debt_ratio",
                                  "code_quality_score")],
        _joined("risk_areas", "rank", "area_name", "risk_level").alias("risk_areas"),
        _joined("maintenance_predictions", "maintenance_type", "predicted_frequency").alias("maintenance"),
        _joined("resource_predictions", "resource_type", "predicted_need").alias("resources"),
        _joined("complexity_predictions", "component", "trend", "confidence_score").alias("outlook_text"),
        outlook[0]["predicted_complexity"].alias("outlook"), "generated_at")


@query("i20_dashboard", DASHBOARD)
def _(spark, sf):
    return _flat(_dashboard(spark, sf))


@query("k1_insights_documents", DASHBOARD)
def _(spark, sf):
    """The exported JSON, written to the shared folder, read back and flattened."""
    documents = insights_document(_dashboard(spark, sf))
    path = f"{shared_folder(spark)}/insights-{uuid.uuid4().hex}"
    write_insights(documents, path)
    stored = (spark.read.schema(documents.drop("repo_id").schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss")
              .json(f"{path}/*"))
    whole = stored.select(F.regexp_extract("_metadata.file_path", "repo_id=([^/]*)", 1).alias("repo_id"), "dashboard.*")
    return _flat(whole)


@query("k1_pretty_json", ROLLUP + TOTALS + """
SELECT repo_id, total_commits, true AS indented FROM metrics""")
def _(spark, sf):
    text = pretty_json(insights_document(_dashboard(spark, sf)))
    return text.select("repo_id", F.get_json_object("document", "$.metrics.total_commits").cast("long").alias("total_commits"),
                       F.contains("document", F.lit("\n  ")).alias("indented"))


def _evolution(spark, sf):
    c, g = X.commits(spark, sf, parents=True), X.gappy_file_changes(spark, sf)
    trends = H.complexity_trends(c, g)
    metrics = I.codebase_metrics(c, trends, X.head_files(spark, sf))
    return H.evolution_insights(c, g, metrics, trends, X.importance(spark, sf))


@query("a17_evolution_insights", ROLLUP + TOTALS + f""",
curve AS (SELECT repo_id, count(*) AS n_days, round(sum(mean), 4) AS day_sum FROM (
  SELECT g.repo_id, CAST(c.committed_at AS DATE) AS day, avg(complexity_after) AS mean
  FROM gappy g JOIN commits c USING (repo_id, commit_hash) WHERE complexity_after IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT c.repo_id, {sql_time('c.a')} AS start_date, {sql_time('c.b')} AS end_date, c.n AS total_commits,
       v.n_days, v.day_sum, m.code_quality_score AS health_score
FROM (SELECT repo_id, min(committed_at) AS a, max(committed_at) AS b, count(*) AS n FROM commits GROUP BY 1) c
LEFT JOIN curve v USING (repo_id) LEFT JOIN metrics m USING (repo_id)""")
def _(spark, sf):
    curve = F.col("complexity_trend")
    return _evolution(spark, sf).header.select(
        "repo_id", "start_date", "end_date", "total_commits", F.size(curve).alias("n_days"),
        F.round(F.aggregate(curve, F.lit(0.0), lambda a, x: a + x), 4).alias("day_sum"), "health_score")


@query("a17_evolution_hotspots", f""", touched AS (
SELECT g.*, c.committed_at, c.author FROM gappy g JOIN commits c USING (repo_id, commit_hash))
SELECT t.repo_id, t.file_path, t.change_frequency, t.last_modified,
       round(CASE WHEN r.complexity IS NULL THEN 0.0
             ELSE 0.4 * least(r.complexity / 30, 1.0) + 0.6 * least(r.change_frequency / 15, 1.0) END, 6) AS risk_score,
       t.contributors
FROM (SELECT repo_id, file_path, count(*) AS change_frequency, {sql_time('max(committed_at)')} AS last_modified,
             string_agg(DISTINCT author, '|' ORDER BY author) AS contributors FROM touched GROUP BY 1, 2) t
LEFT JOIN trends r USING (repo_id, file_path)""")
def _(spark, sf):
    return _evolution(spark, sf).hotspots.select(
        "repo_id", "file_path", "change_frequency", "last_modified", "risk_score",
        F.array_join("contributors", "|").alias("contributors"))


@query("a17_evolution_patterns", """, found AS (
SELECT * FROM (SELECT *, CASE
    WHEN contains(lower(message), 'extract') OR contains(lower(message), 'split') THEN 'extract_method'
    WHEN contains(lower(message), 'rename') THEN 'rename' WHEN contains(lower(message), 'move') THEN 'move'
    WHEN contains(lower(message), 'inline') THEN 'inline' END AS pattern
  FROM commits WHERE contains(lower(message), 'refactor')) WHERE pattern IS NOT NULL),
impact AS (
SELECT g.repo_id, g.commit_hash, g.file_path, 0.4 * (g.insertions + g.deletions) + 0.3 * abs(d.complexity_delta)
       + 0.3 * coalesce(i.importance, 0.0) AS impact
FROM gappy g JOIN deltas d USING (repo_id, commit_hash) LEFT JOIN importance i USING (repo_id, commit_hash))
SELECT f.repo_id, f.pattern, count(DISTINCT f.commit_hash) AS frequency,
       count(DISTINCT i.file_path) AS n_affected_files, round(coalesce(sum(i.impact), 0.0), 6) AS impact_score
FROM found f LEFT JOIN impact i USING (repo_id, commit_hash) GROUP BY 1, 2""")
def _(spark, sf):
    return _evolution(spark, sf).patterns
