"""Checked queries: duplicates, block complexity, suggestions and health."""

from pyspark.sql import functions as F

from ..functions import paths, rules
from ..operators import graph as G, history as H, quality as R
from ..operators.grouping import sized_join
from ..operators.python_source import score_blocks
from ..session import cut_lineage
from . import workload as X
from .registry import query


def _python(spark, sf):
    files = X.python_files(spark, sf)
    return cut_lineage(score_blocks(files)), files


@query("r1_explode_lines", "SELECT * FROM lines", use="lines")
def _(spark, sf):
    return R.explode_lines(X.source_files(spark, sf))


def _duplicates_sql(lines: str, k: int, tag: str = "") -> str:
    return f""", windows{tag} AS (
SELECT repo_id, file_path, line_no,
       string_agg(line, chr(10)) OVER w AS block, count(*) OVER w AS n
FROM {lines} WINDOW w AS (PARTITION BY repo_id, file_path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)),
ranked{tag} AS (
SELECT *, row_number() OVER (PARTITION BY repo_id, block ORDER BY file_path, line_no) AS r,
       count(*) OVER (PARTITION BY repo_id, block) AS occurrences FROM windows{tag} WHERE n = {k}),
dups{tag} AS (
SELECT repo_id, occurrences, file_path, line_no, block AS code_snippet FROM ranked{tag} WHERE r = 1 AND occurrences >= 2)"""


@query("r2_duplicate_blocks", _duplicates_sql("lines", 5) +
       "SELECT repo_id, occurrences, file_path, line_no FROM dups", use="lines")
def _(spark, sf):
    return R.duplicate_blocks(X.source_files(spark, sf)).drop("h1", "h2")


@query("r3_duplicate_snippets", _duplicates_sql("lines", 2) + "SELECT * FROM dups", use="lines")
def _(spark, sf):
    files = X.source_files(spark, sf)
    return R.with_snippet(R.duplicate_blocks(files, 2), files, 2).drop("h1", "h2")


DUPLICATE_ROW = """SELECT repo_id, file_path, 'duplication' AS suggestion_type,
       'Found duplicate code block of ' || occurrences || ' lines' AS description,
       'Code duplication increases maintenance burden and risk of inconsistent updates' AS impact,
       'Medium' AS effort_estimate, code_snippet,
       'Consider extracting this code into a shared function or utility' AS suggested_changes FROM dups"""


@query("r4_duplicate_suggestions", _duplicates_sql("lines", 5) + DUPLICATE_ROW, use="lines")
def _(spark, sf):
    return R.duplicate_suggestions(X.source_files(spark, sf))


@query("r5_score_blocks", """
SELECT repo_id, file_path, kind, name, lineno, endline, n_args, n_methods, complexity FROM blocks""", use="python")
def _(spark, sf):
    from ..operators.python_source import with_sha
    blocks, files = _python(spark, sf)
    kept = blocks.filter(~F.col("kind").isin("module", "import"))
    return sized_join(with_sha(files), kept, "content_sha").drop("content", "content_sha", "is_async")


@query("r5_scored_versions", """, v AS (
SELECT c.repo_id, c.commit_hash, c.parent_hash, CASE WHEN c.commit_hash % 13 <> 0 THEN 1.0 + c.commit_hash % 23 END AS complexity
FROM commits c)
SELECT a.repo_id, a.commit_hash, 'pkg/main.py' AS file_path, b.complexity::DOUBLE AS complexity_before,
       a.complexity::DOUBLE AS complexity_after
FROM v a LEFT JOIN v b ON b.repo_id = a.repo_id AND b.commit_hash = a.parent_hash""")
def _(spark, sf):
    blobs = X.blobs(spark, sf).filter(F.col("content").isNotNull())
    scored = R.blob_complexity(score_blocks(blobs), blobs)
    commits = X.commits(spark, sf, parents=True)
    touches = commits.select("repo_id", "commit_hash", F.lit("pkg/main.py").alias("file_path"))
    return H.attach_complexity(touches, commits, scored)


@query("r6_file_complexity", """
SELECT repo_id, file_path, CASE WHEN k % 29 <> 0 THEN round((9 + m) / 4.0::DOUBLE, 6) ELSE 0.0 END AS complexity FROM py""",
       use="python")
def _(spark, sf):
    return R.file_complexity(*_python(spark, sf))


@query("r7_module_complexity", """
SELECT repo_id, file_path, CASE WHEN k % 29 <> 0 THEN (1 + m)::DOUBLE ELSE 0.0 END AS complexity FROM py""", use="python")
def _(spark, sf):
    return R.module_complexity(*_python(spark, sf))


ADVICE = """concat_ws(chr(10),
  CASE WHEN complexity > 20 THEN 'Consider breaking this function into smaller, more focused functions' END,
  CASE WHEN complexity > 15 THEN 'Look for opportunities to simplify conditional logic' END,
  CASE WHEN complexity > 10 THEN 'Consider extracting complex conditions into well-named helper functions' END)"""
COMPLEX_ROW = f"""SELECT repo_id, file_path, 'complexity' AS suggestion_type,
       'Function ''' || name || ''' has high cyclomatic complexity (' || complexity || ')' AS description,
       'High complexity makes code harder to understand and maintain' AS impact, 'High' AS effort_estimate,
       (SELECT string_agg(line, chr(10) ORDER BY line_no) FROM py_lines l WHERE l.repo_id = b.repo_id
        AND l.file_path = b.file_path AND l.line_no BETWEEN b.lineno AND b.endline) AS code_snippet,
       {ADVICE} AS suggested_changes FROM blocks b WHERE kind = 'function' AND complexity > 10"""


@query("r8_complexity_suggestions", COMPLEX_ROW, use="python")
def _(spark, sf):
    return R.complexity_suggestions(*_python(spark, sf))


@query("r9_complexity_advice", f"SELECT repo_id, file_path, name, {ADVICE} AS advice FROM blocks", use="python")
def _(spark, sf):
    from ..operators.python_source import with_sha
    blocks, files = _python(spark, sf)
    kept = blocks.filter(~F.col("kind").isin("module", "import"))
    return sized_join(with_sha(files), kept, "content_sha").select(
        "repo_id", "file_path", "name", rules.complexity_advice(F.col("complexity")).alias("advice"))


@query("r10_block_source", """
SELECT b.repo_id, b.file_path, b.name, string_agg(l.line, chr(10) ORDER BY l.line_no) AS source
FROM blocks b JOIN py_lines l ON l.repo_id = b.repo_id AND l.file_path = b.file_path
 AND l.line_no BETWEEN b.lineno AND b.endline GROUP BY 1, 2, 3""", use="python")
def _(spark, sf):
    from ..operators.python_source import with_sha
    blocks, files = _python(spark, sf)
    kept = blocks.filter(~F.col("kind").isin("module", "import"))
    return sized_join(with_sha(files), kept, "content_sha").select("repo_id", "file_path", "name", paths.block_source(
        F.col("content"), F.col("lineno"), F.col("endline")).alias("source"))


DEGREES = """, ends AS (
SELECT repo_id, src AS node, 0 AS i, 1 AS o FROM (SELECT DISTINCT repo_id, src, dst FROM {0})
UNION ALL SELECT repo_id, dst, 1, 0 FROM (SELECT DISTINCT repo_id, src, dst FROM {0})),
degrees AS (SELECT repo_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY 1, 2)"""


@query("r12_high_coupling", DEGREES.format("links") + """
SELECT * FROM degrees WHERE in_degree + out_degree > 10""", use="links")
def _(spark, sf):
    return G.high_coupling(X.page_links(spark, sf))


RESOLVED = """, resolved AS (
SELECT i.repo_id, i.src, p.file_path AS dst FROM imports i JOIN py p
ON p.repo_id = i.repo_id AND i.dst = replace(regexp_replace(p.file_path, '\\.py$', ''), '/', '.'))"""


def component_sql(edges: str) -> str:
    return f""", nodes_ AS (SELECT repo_id, src AS node FROM {edges} UNION SELECT repo_id, dst FROM {edges}),
reach(repo_id, a, b) AS (
  SELECT DISTINCT repo_id, src, dst FROM {edges}
  UNION SELECT r.repo_id, r.a, e.dst FROM reach r JOIN {edges} e ON e.repo_id = r.repo_id AND e.src = r.b),
component_of AS (
  SELECT n.repo_id, n.node, least(n.node, coalesce(min(y.b), n.node)) AS component
  FROM nodes_ n LEFT JOIN (SELECT x.repo_id, x.a, x.b FROM reach x JOIN reach z
    ON z.repo_id = x.repo_id AND z.a = x.b AND z.b = x.a) y ON y.repo_id = n.repo_id AND y.a = n.node GROUP BY 1, 2)"""


def cycle_sql(edges: str) -> str:
    """All elementary cycles; paths stay inside the components of ``component_sql``."""
    return f""", inside AS (
  SELECT DISTINCT e.repo_id, e.src, e.dst FROM {edges} e
  JOIN component_of x ON x.repo_id = e.repo_id AND x.node = e.src
  JOIN component_of y ON y.repo_id = e.repo_id AND y.node = e.dst AND y.component = x.component),
walk(repo_id, start, last, path) AS (
  SELECT repo_id, src, dst, [src, dst] FROM inside WHERE src < dst
  UNION ALL SELECT w.repo_id, w.start, e.dst, list_append(w.path, e.dst)
  FROM walk w JOIN inside e ON e.repo_id = w.repo_id AND e.src = w.last
  WHERE e.dst > w.start AND NOT list_contains(w.path, e.dst)),
cycles AS (
  SELECT w.repo_id, w.path AS cycle FROM walk w
  JOIN inside e ON e.repo_id = w.repo_id AND e.src = w.last AND e.dst = w.start
  UNION ALL SELECT DISTINCT repo_id, [src] FROM {edges} WHERE src = dst)"""


def _suggestions(spark, sf):
    blocks, files = _python(spark, sf)
    return R.refactor_analysis(blocks, files), files


ANALYSIS = (_duplicates_sql("py_lines", 5) + DEGREES.format("imports") + RESOLVED + component_sql("resolved")
            + cycle_sql("resolved") + f""", suggestions AS (
{DUPLICATE_ROW} UNION ALL {COMPLEX_ROW} UNION ALL
SELECT repo_id, cycle[1], 'dependency', 'Found circular dependency between ' || array_to_string(cycle, ', '),
       'Circular dependencies make code harder to maintain and test', 'High', NULL, 'Consider restructuring these modules to break the dependency cycle' FROM cycles UNION ALL
SELECT repo_id, node, 'dependency', 'Module has high coupling (' || in_degree || ' incoming, ' || out_degree || ' outgoing dependencies)',
       'High coupling makes the codebase more rigid and harder to change', 'Medium', NULL,
       'Consider splitting this module into smaller, more focused modules'
FROM degrees WHERE in_degree + out_degree > 10)""")


@query("r13_refactor_analysis", ANALYSIS + "SELECT * FROM suggestions", use="python", recursive=True)
def _(spark, sf):
    return _suggestions(spark, sf)[0]


@query("r14_code_health", ANALYSIS + """
SELECT f.repo_id, f.n AS n_files, s.n AS n_suggestions, (round_even((greatest(0.0, 100 - (s.w / f.n) * 20)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE) AS overall_health
FROM (SELECT repo_id, count(*) AS n FROM py_files GROUP BY 1) f
JOIN (SELECT repo_id, count(*) AS n, sum(CASE suggestion_type WHEN 'duplication' THEN 1.0::DOUBLE WHEN 'complexity' THEN 1.5 ELSE 2.0 END) AS w
      FROM suggestions GROUP BY 1) s USING (repo_id)""", use="python", recursive=True)
def _(spark, sf):
    return R.code_health(*_suggestions(spark, sf))


@query("r15_prioritize", ANALYSIS + """
SELECT repo_id, CAST(CASE suggestion_type WHEN 'duplication' THEN 1 WHEN 'complexity' THEN 2 ELSE 3 END AS BIGINT) AS priority,
       file_path, description FROM suggestions""", use="python", recursive=True)
def _(spark, sf):
    return R.prioritize(_suggestions(spark, sf)[0]).select("repo_id", "priority", "file_path", "description")


@query("r16_lexical_complexity", """
SELECT repo_id, file_path, len(regexp_extract_all(content,
       '\\b(?:if|elif|for|while|except|assert|case|and|or)\\b')) + 1 AS complexity FROM files""", use="lines")
def _(spark, sf):
    return X.source_files(spark, sf).select("repo_id", "file_path", R.lexical_complexity(F.col("content")).alias("complexity"))
