"""Registry of checked queries: the Spark plan and, beside it, the same result in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The mapping of workload.py in SQL.
HISTORY_SQL = """
commits AS (
  SELECT 'repo' || (o_custkey % {n}) AS repo_id, o_orderkey AS commit_hash,
         lag(o_orderkey) OVER (PARTITION BY o_custkey % {n} ORDER BY o_orderdate, o_orderkey) AS parent_hash,
         o_orderdate AS committed_at, 'dev' || (o_orderkey % 7) AS author_name,
         'dev' || (o_orderkey % 7) || '@example.org' AS author_email,
         'dev' || (o_orderkey % 7) || ' <dev' || (o_orderkey % 7) || '@example.org>' AS author,
         (['Add feature flag','Fix bug in loader','Refactor: extract helper','Update docs',
           'Refactor rename fields','Optimize query speed','Refactor: move module',
           'Secure token check','Refactor inline loop','Tidy build','Patch release notes',
           'Implement parser'])[CAST(o_orderkey % 12 AS INT) + 1] AS message
  FROM orders),
changes AS (
  SELECT 'repo' || (o_custkey % {n}) AS repo_id, l_orderkey AS commit_hash, file_path,
         CAST(sum(ins) AS BIGINT) AS insertions, CAST(sum(del) AS BIGINT) AS deletions,
         CAST(sum(ins) + sum(del) AS BIGINT) AS lines,
         max(cb) AS complexity_before, max(ca) AS complexity_after
  FROM orders JOIN (
    SELECT l_orderkey,
           CASE WHEN k % 13 = 0 THEN 'file_' || k || '.md'
                ELSE (['app','core','docs','tests','ui','ai','ci'])[CAST(k % 7 AS INT) + 1] || '/' ||
                     (['api','svc','util'])[CAST(k % 3 AS INT) + 1] || '/file_' || k ||
                     (['.py','.js','.java','.txt'])[CAST(k % 4 AS INT) + 1] END AS file_path,
           CAST(l_quantity AS INT) AS ins,
           CAST(round(l_discount * 100) AS INT) + l_linenumber AS del,
           CAST(l_partkey % 31 AS DOUBLE) AS cb, CAST(l_suppkey % 41 AS DOUBLE) AS ca
    FROM (SELECT *, l_partkey % 97 AS k FROM lineitem)) ON l_orderkey = o_orderkey
  GROUP BY 1, 2, 3),
gappy AS (
  SELECT repo_id, commit_hash, file_path, insertions, deletions, lines,
         CASE WHEN commit_hash % 11 <> 3 THEN complexity_before END AS complexity_before,
         CASE WHEN commit_hash % 11 <> 5 THEN complexity_after END AS complexity_after
  FROM changes),
importance AS (
  SELECT c.repo_id, c.commit_hash,
         sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN e.embedding])) AS importance
  FROM commits c JOIN embeddings e ON e.vec_id = c.commit_hash % (SELECT count(*) FROM embeddings)),
deltas AS (
  SELECT c.repo_id, c.commit_hash,
         CASE WHEN any_value(c.parent_hash) IS NULL THEN 0.0
              ELSE coalesce(sum(g.complexity_after - g.complexity_before), 0.0) END AS complexity_delta
  FROM commits c LEFT JOIN gappy g USING (repo_id, commit_hash) GROUP BY 1, 2),
recent AS (
  SELECT repo_id, commit_hash, committed_at,
         row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, commit_hash DESC) AS rn
  FROM commits QUALIFY rn <= 200),
trends AS (
  SELECT g.repo_id, g.file_path,
         coalesce(max_by(g.complexity_after, r.rn) FILTER (WHERE g.complexity_after IS NOT NULL), 0.0) AS complexity,
         count(*) AS change_frequency, min(r.rn) AS first_seen
  FROM gappy g JOIN recent r USING (repo_id, commit_hash) GROUP BY 1, 2)"""

PYTHON_SQL = """
py AS (
  SELECT 'repo' || (p_partkey % 10) AS repo_id, p_partkey AS k, p_partkey % 23 AS m,
         'pkg' || (p_partkey % 100 % 7) || '/mod_' || p_partkey || '.py' AS file_path,
         10 * (p_partkey // 80 * 8 + CASE WHEN p_partkey // 10 % 8 < 1 + p_partkey // 80 % 7
                THEN (p_partkey // 10 % 8 + 1) % (1 + p_partkey // 80 % 7) ELSE p_partkey // 10 % 8 - 1 END) + p_partkey % 10 AS t
  FROM part),
py_files AS (
  SELECT repo_id, file_path, CASE WHEN k % 29 = 0 THEN 'def broken(:' || chr(10) ELSE '' END ||
         replace('import lib' || (k % 5) || '.core, util' || (k % 3) || '~from pkg' || (t % 100 % 7) || '.mod_' || t ||
                 ' import run~from . import local~~~def run(a, b):~' ||
                 repeat('    if a > b:~        a -= 1~', CAST(m AS INT)) ||
                 '    return a~~~class Box:~    def get(self):~        return 1 if self.v else 0~~' ||
                 '    def put(self, x, y):~        self.v = x and y or self.v~', '~', chr(10)) AS content
  FROM py),
py_lines AS (
  SELECT repo_id, file_path, unnest(range(1, len(a))) AS line_no, unnest(a[1:len(a) - 1]) AS line
  FROM (SELECT repo_id, file_path, string_split(content, chr(10)) AS a FROM py_files)),
ok AS (SELECT * FROM py WHERE k % 29 <> 0),
blocks AS (
  SELECT repo_id, file_path, k, 'function' AS kind, 'run' AS name, 6::BIGINT AS lineno, 7 + 2 * m AS endline, 2::BIGINT AS n_args, 0::BIGINT AS n_methods, 1 + m AS complexity FROM ok
  UNION ALL SELECT repo_id, file_path, k, 'class', 'Box', 10 + 2 * m, 15 + 2 * m, 0, 2, 3 FROM ok
  UNION ALL SELECT repo_id, file_path, k, 'method', 'get', 11 + 2 * m, 12 + 2 * m, 1, 0, 2 FROM ok
  UNION ALL SELECT repo_id, file_path, k, 'method', 'put', 14 + 2 * m, 15 + 2 * m, 3, 0, 3 FROM ok),
imports AS (
  SELECT repo_id, file_path AS src, 'lib' || (k % 5) || '.core' AS dst FROM ok
  UNION SELECT repo_id, file_path, 'util' || (k % 3) FROM ok
  UNION SELECT repo_id, file_path, 'pkg' || (t % 100 % 7) || '.mod_' || t FROM ok)"""

LINES_SQL = """
files AS (SELECT lang AS repo_id, 'src' || doc_id || '.py' AS file_path, text AS content FROM documents),
parts AS (
  SELECT repo_id, file_path,
         regexp_split_to_array(content, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS a
  FROM files),
cut AS (SELECT repo_id, file_path, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM parts),
lines AS (
  SELECT repo_id, file_path, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM cut)"""

LINKS_SQL = """
links AS (
  SELECT 'site' || (page_id % 4) AS repo_id, '/page/' || page_id AS src,
         unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)"""

CYCLES_SQL = """
pb AS (
  SELECT p_partkey AS k, p_partkey // 8 AS b, p_partkey % 8 AS p, 1 + (p_partkey // 8) % 7 AS s,
         'repo' || ((p_partkey // 8) // 3 % 2) AS repo_id FROM part),
pe AS (
  SELECT repo_id, 'm' || lpad(CAST(k AS VARCHAR), 9, '0') AS src,
         'm' || lpad(CAST(b * 8 + CASE WHEN p < s THEN (p + 1) % s ELSE p - 1 END AS VARCHAR), 9, '0') AS dst FROM pb
  UNION ALL SELECT repo_id, 'm' || lpad(CAST(k AS VARCHAR), 9, '0'), 'm' || lpad(CAST(b * 8 + 8 AS VARCHAR), 9, '0')
  FROM pb WHERE p = 7 AND b % 3 <> 2)"""

PARTS = {"history": HISTORY_SQL, "python": PYTHON_SQL, "lines": LINES_SQL, "links": LINKS_SQL, "cycles": CYCLES_SQL}


def plain(df: DataFrame) -> DataFrame:
    """Comparable columns: whole numbers as long, doubles at six places, times as text."""
    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # Scale, round, scale back: the steps of the SQL side, so ties fall alike.
            rounded = F.round(c.cast("double") * 1e6, 0) / 1e6
            return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        return c.alias(f.name)
    return df.select(*[column(f) for f in df.schema])


def query(name: str, sql: str | None = None, use: str = "history", n: int = 50, recursive: bool = False):
    """Register a plan under ``name``; ``sql`` continues the WITH list named by ``use``."""
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        if sql is not None:
            head = ",".join(PARTS[p].format(n=n) for p in use.split())
            ORACLE[name] = f"WITH {'RECURSIVE ' if recursive else ''}{head}{sql}"
        return build
    return register


TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def sql_time(column: str) -> str:
    return TIME.format(column)
