"""Checked queries: the module graph."""

from pyspark.sql import functions as F

from ..operators import graph as G, history as H
from ..operators.python_source import score_blocks
from ..session import cut_lineage
from . import workload as X
from .checks_source import DEGREES, RESOLVED, component_sql, cycle_sql
from .registry import query


def _python(spark, sf):
    files = X.python_files(spark, sf)
    return cut_lineage(score_blocks(files)), files


@query("g1_import_edges", "SELECT repo_id, src, dst, 'import' AS type FROM imports", use="python")
def _(spark, sf):
    return G.import_edges(*_python(spark, sf))


@query("g1_page_links", "SELECT repo_id, src, dst FROM links", use="links")
def _(spark, sf):
    return X.page_links(spark, sf).drop("type")


NODES = """, nodes AS (
SELECT repo_id, node, string_split(node, '/')[-1] AS name, coalesce(max(size), 1) AS size FROM (
  SELECT repo_id, file_path AS node, 15 + 2 * m AS size FROM ok
  UNION ALL SELECT repo_id, src, NULL FROM imports UNION ALL SELECT repo_id, dst, NULL FROM imports)
GROUP BY 1, 2)"""


@query("g2_module_nodes", NODES + "SELECT * FROM nodes", use="python")
def _(spark, sf):
    blocks, files = _python(spark, sf)
    return G.module_nodes(G.import_edges(blocks, files), G.parsed_modules(blocks, files))


@query("g3_module_connections", """
SELECT DISTINCT repo_id, src AS source, dst AS target, 1.0::DOUBLE AS strength, 'import' AS type FROM links""", use="links")
def _(spark, sf):
    return G.module_connections(X.page_links(spark, sf))


@query("g4_resolve_imports", RESOLVED + "SELECT *, 'import' AS type FROM resolved", use="python")
def _(spark, sf):
    blocks, files = _python(spark, sf)
    return G.resolve_imports(G.import_edges(blocks, files), files)


@query("g5_degrees", DEGREES.format("links") + "SELECT * FROM degrees", use="links")
def _(spark, sf):
    return G.degrees(X.page_links(spark, sf))


def _modularity_sql(edges: str, community: str) -> str:
    return f""", und AS (SELECT DISTINCT repo_id, least(src, dst) AS a, greatest(src, dst) AS b FROM {edges}),
deg AS (SELECT repo_id, node, count(*) AS d FROM (SELECT repo_id, a AS node FROM und UNION ALL SELECT repo_id, b FROM und) GROUP BY 1, 2),
com AS (SELECT repo_id, node, {community} AS c, d FROM deg),
per AS (SELECT repo_id, c, sum(d) AS d FROM com GROUP BY 1, 2),
inner_ AS (SELECT u.repo_id, x.c, count(*) AS l FROM und u JOIN com x ON x.repo_id = u.repo_id AND x.node = u.a
           JOIN com y ON y.repo_id = u.repo_id AND y.node = u.b AND y.c = x.c GROUP BY 1, 2),
mod_ AS (SELECT p.repo_id, sum(coalesce(i.l, 0) / t.m::DOUBLE - (p.d / (2.0::DOUBLE * t.m)) ** 2) AS q
         FROM per p LEFT JOIN inner_ i USING (repo_id, c) JOIN (SELECT repo_id, count(*) AS m FROM und GROUP BY 1) t USING (repo_id) GROUP BY 1)"""


FOLDER = "regexp_replace(node, '/?[^/]*$', '')"
METADATA = """
SELECT n.repo_id, n.n AS total_modules, e.n AS total_dependencies, round(e.n / n.n::DOUBLE, 6) AS avg_dependencies,
       s.n AS strongly_connected_components, round(q.q, 6) AS modularity
FROM (SELECT repo_id, count(*) AS n FROM {nodes} GROUP BY 1) n
JOIN (SELECT repo_id, count(*) AS n FROM (SELECT DISTINCT repo_id, src, dst FROM {edges}) GROUP BY 1) e USING (repo_id)
JOIN (SELECT repo_id, count(DISTINCT component) AS n FROM component_of GROUP BY 1) s USING (repo_id)
JOIN mod_ q USING (repo_id)"""


@query("g6_graph_metadata", component_sql("links") + _modularity_sql("links", FOLDER) +
       METADATA.format(nodes="nodes_", edges="links"), use="links", recursive=True)
def _(spark, sf):
    edges = X.page_links(spark, sf)
    return G.graph_metadata(G.graph_nodes(edges), edges, G.strongly_connected(edges), G.folder_communities(edges))


@query("g7_strongly_connected", component_sql("pe") + "SELECT * FROM component_of", use="cycles", recursive=True)
def _(spark, sf):
    edges = X.part_edges(spark, sf)
    return G.component_labels(edges, G.strongly_connected(edges))


@query("g7_strongly_connected_imports", RESOLVED + component_sql("resolved") + "SELECT * FROM component_of",
       use="python", recursive=True)
def _(spark, sf):
    blocks, files = _python(spark, sf)
    edges = G.resolve_imports(G.import_edges(blocks, files), files)
    return G.component_labels(edges, G.strongly_connected(edges))


CYCLE_ROWS = "SELECT repo_id, array_to_string(cycle, ',') AS cycle FROM cycles"


@query("r11_circular_dependencies", component_sql("pe") + cycle_sql("pe") + CYCLE_ROWS, use="cycles", recursive=True)
def _(spark, sf):
    edges = X.part_edges(spark, sf)
    found = G.circular_dependencies(edges, G.strongly_connected(edges))
    return found.select("repo_id", F.array_join("cycle", ",").alias("cycle"))


@query("r11_circular_imports", RESOLVED + component_sql("resolved") + cycle_sql("resolved") + CYCLE_ROWS, use="python", recursive=True)
def _(spark, sf):
    blocks, files = _python(spark, sf)
    found = G.circular_dependencies(G.resolve_imports(G.import_edges(blocks, files), files))
    return found.select("repo_id", F.array_join("cycle", ",").alias("cycle"))


@query("g8_modularity", _modularity_sql("links", FOLDER) + "SELECT repo_id, round(q, 6) AS modularity FROM mod_", use="links")
def _(spark, sf):
    edges = X.page_links(spark, sf)
    return G.modularity(edges, G.folder_communities(edges))


@query("g8_connected_communities", """, both_ AS (SELECT repo_id, src AS a, dst AS b FROM pe UNION SELECT repo_id, dst, src FROM pe),
near(repo_id, a, b) AS (
  SELECT repo_id, a, a FROM both_
  UNION SELECT n.repo_id, n.a, e.b FROM near n JOIN both_ e ON e.repo_id = n.repo_id AND e.a = n.b)
SELECT repo_id, a AS node, min(b) AS community FROM near GROUP BY 1, 2""", use="cycles", recursive=True)
def _(spark, sf):
    return G.connected_communities(X.part_edges(spark, sf))


WHOLE = """, both_ AS (SELECT repo_id, src AS a, dst AS b FROM pe UNION SELECT repo_id, dst, src FROM pe),
near(repo_id, a, b) AS (
  SELECT repo_id, a, a FROM both_
  UNION SELECT n.repo_id, n.a, e.b FROM near n JOIN both_ e ON e.repo_id = n.repo_id AND e.a = n.b),
whole AS (SELECT repo_id, a AS node, min(b) AS component FROM near GROUP BY 1, 2)"""


@query("g8_modular_communities", WHOLE + _modularity_sql("pe", "(SELECT w.component FROM whole w WHERE w.repo_id = deg.repo_id AND w.node = deg.node)") + """
SELECT q.repo_id, n.nodes, round(q.q, 6) AS whole_modularity, true AS no_worse, n.nodes AS nodes_inside
FROM mod_ q JOIN (SELECT repo_id, count(*) AS nodes FROM whole GROUP BY 1) n USING (repo_id)""", use="cycles", recursive=True)
def _(spark, sf):
    """The searched partition: every node once, inside its component, and never a lower score than the components."""
    edges = X.part_edges(spark, sf)
    found = cut_lineage(G.modular_communities(edges))
    whole = cut_lineage(G.connected_communities(edges))
    home = whole.select("repo_id", F.col("node").alias("community"), F.col("community").alias("_home"))
    placed = (found.join(home, ["repo_id", "community"])
              .join(whole.withColumnRenamed("community", "_whole"), ["repo_id", "node"]).groupBy("repo_id").agg(
                  F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("_home") == F.col("_whole")).alias("nodes_inside")))
    score = G.modularity(edges, found).withColumnRenamed("modularity", "_found")
    return (G.modularity(edges, whole).join(score, "repo_id").join(placed, "repo_id").select(
        "repo_id", "nodes", F.col("modularity").alias("whole_modularity"),
        (F.col("_found") >= F.col("modularity") - 1e-12).alias("no_worse"), "nodes_inside"))


@query("g6_graph_metadata_cycles", component_sql("pe") + _modularity_sql("pe", "node") +
       METADATA.format(nodes="nodes_", edges="pe"), use="cycles", recursive=True)
def _(spark, sf):
    edges = X.part_edges(spark, sf)
    own = G.graph_nodes(edges).withColumn("community", F.col("node"))
    return G.graph_metadata(G.graph_nodes(edges), edges, G.strongly_connected(edges), own)


def color_sql(health: str) -> str:
    """Hex colour of a health column: hue 0.3 * health, saturation 0.8, value 0.9."""
    turn = f"(({health}) * 0.3::DOUBLE * 6.0::DOUBLE)"
    rising = f"(0.9::DOUBLE * (1.0::DOUBLE - 0.8::DOUBLE * (1.0::DOUBLE - {turn})))"
    falling = f"(0.9::DOUBLE * (1.0::DOUBLE - 0.8::DOUBLE * ({turn} - 1)))"
    one = "printf('%02x', CAST(trunc({0} * 255) AS INT))"
    # Value 0.9 gives e5 and the constant third channel 2d.
    return (f"'#' || CASE WHEN trunc({turn}) = 0 THEN 'e5' || {one.format(rising)} "
            f"ELSE {one.format(falling)} || 'e5' END || '2d'")


@query("g9_hotspot_nodes", f""", f AS (SELECT repo_id, file_path, count(*) AS frequency FROM changes GROUP BY 1, 2),
j AS (SELECT f.repo_id, f.file_path, f.frequency, coalesce(t.complexity, 0.0) AS complexity FROM f LEFT JOIN trends t USING (repo_id, file_path))
SELECT repo_id, file_path AS id, string_split(file_path, '/')[-1] AS name, 'module' AS type,
       CAST(trunc(complexity) AS BIGINT) AS size, {color_sql('1 - (least(1.0::DOUBLE, frequency / 50.0::DOUBLE) * 0.4::DOUBLE + least(1.0::DOUBLE, complexity / 30.0::DOUBLE) * 0.6::DOUBLE)')} AS color
FROM j WHERE frequency > 10 OR complexity > 20""")
def _(spark, sf):
    trends = H.complexity_trends(X.commits(spark, sf), X.gappy_file_changes(spark, sf))
    return G.hotspot_nodes(X.file_changes(spark, sf), trends).drop("position")


@query("g10_module_dependencies", """
SELECT DISTINCT repo_id, src AS module, dst AS dependency FROM links""", use="links")
def _(spark, sf):
    return G.module_dependencies(X.page_links(spark, sf))


@query("g11_class_listing", """
SELECT repo_id, file_path, name, n_methods AS methods, lineno AS line_number FROM blocks WHERE kind = 'class'""", use="python")
def _(spark, sf):
    return G.class_listing(*_python(spark, sf))


@query("g12_function_listing", """
SELECT repo_id, file_path, name, n_args AS args, lineno AS line_number FROM blocks WHERE kind <> 'class'""", use="python")
def _(spark, sf):
    return G.function_listing(*_python(spark, sf))


@query("g13_module_details", """
SELECT repo_id, file_path, 'mod_' || k || '.py' AS name, 15 + 2 * m AS size, (10 + 2 * m) || ':Box:2' AS classes,
       '6:run:2|' || (11 + 2 * m) || ':get:1|' || (14 + 2 * m) || ':put:3' AS functions,
       'lib' || (k % 5) || '.core|pkg' || (t % 100 % 7) || '.mod_' || t || '|util' || (k % 3) AS dependencies,
       (1 + m)::DOUBLE AS complexity, CASE WHEN k % 3 <> 1 THEN '2024-01-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') END AS last_modified
FROM ok""", use="python")
def _(spark, sf):
    blocks, files = _python(spark, sf)
    k = F.regexp_extract("file_path", r"mod_(\d+)", 1).cast("long")
    modified = files.filter(k % 3 != 1).select("repo_id", "file_path", F.concat(
        F.lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("last_modified"))
    rows = G.module_details(blocks, files, modified)
    flat = lambda a, *names: F.array_join(F.transform(
        a, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), "|")
    return rows.select("repo_id", "file_path", "name", "size",
                       flat("classes", "line_number", "name", "methods").alias("classes"),
                       flat("functions", "line_number", "name", "args").alias("functions"),
                       F.array_join("dependencies", "|").alias("dependencies"), "complexity", "last_modified")


@query("g14_code_map_nodes", NODES + DEGREES.format("imports") + f"""
SELECT n.repo_id, n.node AS id, n.name, 'module' AS type, n.size,
       {color_sql('1 - (((d.in_degree + d.out_degree) / c.n::DOUBLE) * 0.5::DOUBLE + least(1.0::DOUBLE, n.size / 1000.0::DOUBLE) * 0.5::DOUBLE)')} AS color
FROM nodes n JOIN degrees d USING (repo_id, node) JOIN (SELECT repo_id, count(*) AS n FROM nodes GROUP BY 1) c USING (repo_id)""",
       use="python")
def _(spark, sf):
    blocks, files = _python(spark, sf)
    edges = G.import_edges(blocks, files)
    return G.colored_nodes(G.module_nodes(edges, G.parsed_modules(blocks, files)), edges).drop("position")


@query("g14_code_map_metadata", NODES + component_sql("imports") + _modularity_sql("imports", FOLDER) +
       METADATA.format(nodes="nodes", edges="imports"), use="python", recursive=True)
def _(spark, sf):
    return G.code_map(*_python(spark, sf)).metadata
