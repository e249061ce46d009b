"""Module-graph operators over ``edges(repo_id, src, dst, type)``."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import colors
from ..functions.paths import basename, directory, dotted_name
from ..session import written
from .grouping import sized_join, skew_join
from .history import FILE, commit_frequency
from .python_source import with_sha

NODE = ["repo_id", "node"]


class CodeMap(NamedTuple):
    """The three parts of a code map, each a table of rows for many repositories."""

    nodes: DataFrame
    connections: DataFrame
    metadata: DataFrame


def import_edges(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """File to imported module name; relative imports without a module are left out."""
    names = blocks.filter(F.col("kind") == "import").select("content_sha", F.col("name").alias("dst")).distinct()
    return (sized_join(with_sha(files).select("repo_id", F.col("file_path").alias("src"), "content_sha"), names, "content_sha")
            .select("repo_id", "src", "dst", F.lit("import").alias("type")))


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose target is a file of the same repository, as file-to-file edges."""
    known = files.select("repo_id", dotted_name(F.col("file_path")).alias("dst"),
                         F.col("file_path").alias("target"))
    return sized_join(edges, known, ["repo_id", "dst"]).select(
        "repo_id", "src", F.col("target").alias("dst"), "type")


def module_connections(edges: DataFrame) -> DataFrame:
    """Distinct edges with strength 1."""
    return edges.groupBy("repo_id", "src", "dst").agg(F.min("type").alias("type")).select(
        "repo_id", F.col("src").alias("source"), F.col("dst").alias("target"),
        F.lit(1.0).alias("strength"), "type")


def graph_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select("repo_id", F.explode(F.array("src", "dst")).alias("node"))
    return ends.distinct()


def module_nodes(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Files with their line count together with edge ends that are no file (size 1).

    ``modules``: repo_id, file_path, size.
    """
    sized = modules.select("repo_id", F.col("file_path").alias("node"), F.col("size").cast("long").alias("_size"))
    ends = edges.select("repo_id", F.explode(F.array("src", "dst")).alias("node"),
                        F.lit(None).cast("long").alias("_size"))
    return (sized.unionByName(ends).groupBy(*NODE)
            .agg(F.coalesce(F.max("_size"), F.lit(1).cast("long")).alias("size"))
            .select(*NODE, basename(F.col("node")).alias("name"), "size"))


def parsed_modules(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Files that parse, with their line count."""
    parsed = blocks.filter(F.col("kind") == "module").select("content_sha", F.col("endline").alias("size"))
    return sized_join(with_sha(files).select(*FILE, "content_sha"), parsed, "content_sha").select(*FILE, "size")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct incoming and outgoing edges per node."""
    one = edges.select("repo_id", "src", "dst").distinct()
    zero, unit = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = one.select("repo_id", F.inline(F.array(
        F.struct(F.col("src").alias("node"), zero.alias("i"), unit.alias("o")),
        F.struct(F.col("dst").alias("node"), unit.alias("i"), zero.alias("o")))))
    return ends.groupBy(*NODE).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def high_coupling(edges: DataFrame, threshold: int = 10) -> DataFrame:
    return degrees(edges).filter(F.col("in_degree") + F.col("out_degree") > threshold)


def colored_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes as records with colour (coupling and size) and position (path)."""
    counts = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = (skew_join(sized_join(nodes, degrees(edges), NODE, "left"), counts, ["repo_id"])
            .fillna(0, ["in_degree", "out_degree"]))
    return rows.select(
        "repo_id", F.col("node").alias("id"), "name", F.lit("module").alias("type"), "size",
        colors.node_color(F.col("in_degree"), F.col("out_degree"), F.col("size"), F.col("_n")).alias("color"),
        colors.path_position(F.col("node")).alias("position"))


def hotspot_nodes(file_changes: DataFrame, complexity: DataFrame) -> DataFrame:
    """Files changed more than ten times or more complex than 20. ``complexity``: per file."""
    f, c = F.col("frequency"), F.col("complexity")
    rows = (commit_frequency(file_changes).join(complexity.select(*FILE, "complexity"), FILE, "left")
            .withColumn("complexity", F.coalesce(c, F.lit(0.0))).filter((f > 10) | (c > 20)))
    return rows.select(
        "repo_id", F.col("file_path").alias("id"), basename(F.col("file_path")).alias("name"),
        F.lit("module").alias("type"), c.cast("long").alias("size"),
        colors.health_color(f, c).alias("color"),
        colors.path_position(F.col("file_path")).alias("position"))


def module_dependencies(edges: DataFrame, module: str | None = None) -> DataFrame:
    """Distinct targets of one module, or of every module."""
    kept = edges if module is None else edges.filter(F.col("src") == module)
    return kept.select("repo_id", F.col("src").alias("module"), F.col("dst").alias("dependency")).distinct()


def _empty(df: DataFrame) -> bool:
    return df.isEmpty()


def _inner_edges(pairs: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``keep``, a table of nodes keyed as ``pairs`` is."""
    key = [c for c in pairs.columns if c not in ("src", "dst")]
    for end in ("src", "dst"):
        pairs = sized_join(pairs, keep.withColumnRenamed("node", end), [*key, end], "left_semi")
    return pairs.select(*key, "src", "dst")


def trim(pairs: DataFrame) -> DataFrame:
    """Drop edges at nodes without incoming or without outgoing edges. Columns besides the ends are part of the key."""
    key = [c for c in pairs.columns if c not in ("src", "dst")]
    ends = pairs.select(*key, F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    both = ends.groupBy(*key, "node").agg(F.max("o").alias("o"), F.max("i").alias("i")).filter("o = 1 and i = 1")
    return _inner_edges(pairs, both.select(*key, "node"))


def _least_both_ways(pairs: DataFrame) -> DataFrame:
    """``node, least_from, least_to``: the smallest node that reaches a node, and the smallest it reaches.

    Both directions are walked at once, as two halves of one table of arcs. In a round a node takes the smallest
    label of itself and of the nodes one arc before it, then that label's own label, so that what a node knows
    of a long chain grows by a factor instead of by one. Each round is cut from the one before; runs until no label
    changes, and minima are combined before the exchange.
    """
    key = ["onward", "node"]
    arcs = written(pairs.select(F.inline(F.array(
        F.struct(F.lit(True).alias("onward"), F.col("src").alias("before"), F.col("dst").alias("node")),
        F.struct(F.lit(False).alias("onward"), F.col("dst").alias("before"), F.col("src").alias("node"))))))
    labels = written(arcs.select("onward", F.explode(F.array("before", "node")).alias("node")).distinct()
                         .withColumn("label", F.col("node")))

    while True:
        told = skew_join(arcs, labels.withColumnRenamed("node", "before").hint("merge"), ["onward", "before"])
        met = (told.select(*key, "label", F.lit(None).cast("long").alias("_last"))
               .unionByName(labels.withColumn("_last", F.col("label")))
               .groupBy(*key).agg(F.min("label").alias("label"), F.max("_last").alias("_last")))
        up = met.select("onward", F.col("node").alias("label"), F.col("label").alias("_up"))
        new = written(skew_join(met, up.hint("merge"), ["onward", "label"]).select(
            *key, F.col("_up").alias("label"), (F.col("_up") < F.col("_last")).alias("changed")))
        labels = new.select(*key, "label")
        if _empty(new.filter("changed")):
            break
    return labels.groupBy("node").agg(F.min(F.when(F.col("onward"), F.col("label"))).alias("least_from"),
                                      F.min(F.when(~F.col("onward"), F.col("label"))).alias("least_to"))


def _number(node: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "repo_id", node)


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, repo_id, node`` of all ends, and the distinct edges ``src, dst`` between two nodes by these numbers.

    A number is the hash of repository and name. If any two nodes share one, all are hashed anew with another salt.
    """
    ends = graph_nodes(edges).filter("repo_id is not null and node is not null")
    salt = 0
    while True:
        nodes = written(ends.withColumn("id", _number("node", salt)))
        if _empty(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")):
            break
        salt += 1
    pairs = edges.filter(F.col("repo_id").isNotNull() & (F.col("src") != F.col("dst")))
    return nodes, written(pairs.select(_number("src", salt).alias("src"), _number("dst", salt).alias("dst")).distinct())


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``repo_id, node, component`` for every component of two or more nodes, named by its smallest node.

    Round by round each node learns the smallest node that reaches it and the smallest that it reaches. Where both
    are the same node, they share its component; any two nodes of one component agree in both, so edges
    between nodes that do not are dropped, and the rest goes on. Each round settles at least the component of every node
    smaller than all it is connected with. Nodes are compared by a number, the hash of repository and name: the number
    of rounds does not depend on how names follow the edges, and names move only before and after the rounds.
    """
    spark = edges.sparkSession
    nodes, pairs = _numbered(edges)
    left = written(trim(pairs))
    found = None
    while not _empty(left):
        sides = written(_least_both_ways(left))
        part = sides.filter("least_from = least_to").select(F.col("node").alias("id"), F.col("least_from").alias("_group"))
        found = part if found is None else found.unionByName(part)
        rest = sides.filter("least_from <> least_to")
        at = lambda end: rest.select(F.col("node").alias(end), "least_from", "least_to").hint("merge")
        same = (skew_join(left, at("src"), ["src"])
                .join(at("dst"), ["dst", "least_from", "least_to"]).select("src", "dst"))
        left = written(trim(same))
    if found is None:
        return spark.createDataFrame([], "repo_id string, node string, component string")
    found = sized_join(found, nodes, "id")
    named = found.groupBy("_group").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("_n"))
    return (skew_join(found, named.filter("_n > 1").hint("merge"), ["_group"])
            .select("repo_id", "node", "component"))


def component_labels(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Component of every node; a node outside the larger components is its own."""
    return sized_join(graph_nodes(edges), components, NODE, "left").select(
        *NODE, F.coalesce("component", "node").alias("component"))


def circular_dependencies(edges: DataFrame, components: DataFrame | None = None,
                          max_len: int | None = None) -> DataFrame:
    """Every elementary cycle, once, from its smallest node.

    Paths are walked inside strongly connected components only, as no cycle leaves one, until none can be
    made longer; each hop is cut from the one before. A path grows only to nodes that still reach its start
    over nodes larger than the start (``ways_home``). ``components`` comes from ``strongly_connected`` where it is
    at hand already. The number of cycles of a dense component grows without bound by nature; a caller who wants
    short ones only passes ``max_len``, which also ends paths too far from their start to come back in time.
    """
    all_pairs = written(edges.select("repo_id", "src", "dst").distinct())
    found = [all_pairs.filter(F.col("src") == F.col("dst")).select("repo_id", F.array("src").alias("cycle"))]
    ends = (strongly_connected(all_pairs) if components is None else components).select(*NODE, "component")
    pairs = sized_join(all_pairs.filter(F.col("src") != F.col("dst")), ends.withColumnRenamed("node", "src"), ["repo_id", "src"])
    pairs = written(sized_join(pairs, ends.withColumnRenamed("node", "dst"), ["repo_id", "dst", "component"])
                    .select("repo_id", "src", "dst"))
    home = ways_home(pairs, max_len)
    step = pairs.select("repo_id", F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = pairs.select("repo_id", F.col("src").alias("start"), F.col("dst").alias("last"),
                         F.array("src", "dst").alias("cycle"))
    length = 2
    while True:
        left = F.lit(True) if max_len is None else F.col("hops") + length <= max_len
        paths = written(sized_join(paths, home, ["repo_id", "start", "last"]).filter(left))
        if _empty(paths):
            break
        found.append(paths.filter("hops = 1").select("repo_id", "cycle"))
        paths = (sized_join(paths.select("repo_id", "start", "last", "cycle"), step, ["repo_id", "last"])
                 .filter((F.col("next") > F.col("start")) & ~F.array_contains("cycle", F.col("next")))
                 .select("repo_id", "start", F.col("next").alias("last"),
                         F.concat("cycle", F.array("next")).alias("cycle")))
        length += 1
    return reduce(DataFrame.unionByName, found)


def ways_home(pairs: DataFrame, max_len: int | None = None) -> DataFrame:
    """``repo_id, start, last, hops``: nodes larger than ``start`` that reach it over larger nodes, with the least
    number of edges.

    Walked backwards from every start at once, one hop a job. Only starts with an edge to a larger node and one from a
    larger node take part. With ``max_len`` no way is longer than a cycle of that length allows.
    """
    out = pairs.filter(F.col("dst") > F.col("src")).select("repo_id", F.col("src").alias("start")).distinct()
    back = pairs.select("repo_id", F.col("dst").alias("last"), F.col("src").alias("before"))
    closing = pairs.filter(F.col("src") > F.col("dst")).select("repo_id", F.col("dst").alias("start"), F.col("src").alias("last"))
    ring = written(sized_join(closing, out, ["repo_id", "start"], "left_semi").withColumn("hops", F.lit(1)))
    known, hops = ring, 1
    while (max_len is None or hops < max_len - 1) and not _empty(ring):
        hops += 1
        reached = (sized_join(ring, back, ["repo_id", "last"]).filter(F.col("before") > F.col("start"))
                   .select("repo_id", "start", F.col("before").alias("last")).distinct())
        ring = written(sized_join(reached, known, ["repo_id", "start", "last"], "left_anti").withColumn("hops", F.lit(hops)))
        known = known.unionByName(ring)
    return written(known)


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def folder_communities(edges: DataFrame) -> DataFrame:
    """Nodes grouped by their folder."""
    return graph_nodes(edges).select(*NODE, directory(F.col("node")).alias("community"))


def connected_communities(edges: DataFrame) -> DataFrame:
    """Nodes grouped by connected component, named by its smallest node.

    Each round a node takes the smallest label of itself and its neighbours, then its label's own label, so a
    chain costs the logarithm of its length in rounds. Runs until no label changes; minima are combined
    before the exchange.
    """
    links = _undirected(edges).filter("a <> b")
    both = written(links.select("repo_id", F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))))
    labels = written(graph_nodes(edges).withColumn("community", F.col("node")))
    while True:
        near = (skew_join(both, labels.withColumnRenamed("node", "other"), ["repo_id", "other"])
                .groupBy(*NODE).agg(F.min("community").alias("_near")))
        # The smallest label near a node is told to the node's present label as well.
        told = labels.join(near, NODE).groupBy("repo_id", F.col("community").alias("node")).agg(
            F.min("_near").alias("_told"))
        least = (labels.join(near, NODE, "left").join(told, NODE, "left")
                 .select(*NODE, F.col("community").alias("_old"), F.least("community", "_near", "_told").alias("_mid")))
        least = written(least)
        up = least.select("repo_id", F.col("node").alias("_mid"), F.col("_mid").alias("_up"))
        new = written(least.join(up, ["repo_id", "_mid"]).select(
            *NODE, F.col("_up").alias("community"), (F.col("_up") != F.col("_old")).alias("changed")))
        labels = new.select(*NODE, "community")
        if _empty(new.filter("changed")):
            return labels


def _undirected_degrees(links: DataFrame) -> DataFrame:
    ends = links.select("repo_id", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_d"))


def community_scores(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Per community its edges inside, its degree and the edges of the repository: ``_inner, _degree, _m``."""
    links = _undirected(edges)
    share = (sized_join(_undirected_degrees(links), communities, NODE)
             .groupBy("repo_id", "community").agg(F.sum("_d").alias("_degree")))
    near = skew_join(links, communities.withColumnRenamed("node", "a").hint("merge"), ["repo_id", "a"])
    far = communities.select("repo_id", F.col("node").alias("b"), "community").hint("merge")
    inner = (skew_join(near, far, ["repo_id", "b", "community"])
             .groupBy("repo_id", "community").agg(F.count(F.lit(1)).alias("_inner")))
    total = links.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_m"))
    return (sized_join(share, inner, ["repo_id", "community"], "left").fillna(0, ["_inner"]).join(total, "repo_id")
            .select("repo_id", "community", "_inner", "_degree", "_m"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Sum over communities of inner edge share minus the squared degree share."""
    m = F.col("_m")
    term = F.col("_inner") / m - F.pow(F.col("_degree") / (2.0 * m), F.lit(2))
    return community_scores(edges, communities).groupBy("repo_id").agg(F.sum(term).alias("modularity"))


def _best_partners(ties: DataFrame) -> DataFrame:
    """Of every community that gains from a merge the partner with the largest gain, ties by name."""
    gain = 2 * F.col("m") * F.col("w") - F.col("ka") * F.col("kb")
    order = (-gain).alias("loss"), F.col("a").alias("lo"), F.col("b").alias("hi")
    side = lambda own, other: F.struct(
        F.col(own).alias("community"), F.struct(*order, F.col(other).alias("to"), F.col("k" + own).alias("own"),
                                                F.col("k" + other).alias("its"), "w", "m").alias("pick"))
    return written(
        ties.filter(gain > 0).select("repo_id", F.inline(F.array(side("a", "b"), side("b", "a"))))
        .groupBy("repo_id", "community").agg(F.min("pick").alias("pick")).select("repo_id", "community", "pick.*"))


def _merges(asking: DataFrame) -> DataFrame:
    """``repo_id, community, to, k`` with the new degree, for the communities that move and those they join."""
    asked = asking.groupBy("repo_id", "to").agg(
        F.sum("own").alias("all"), F.min(F.struct("loss", "lo", "hi", "community")).alias("first"))
    joining = written(
        skew_join(asking, asked, ["repo_id", "to"])
        .filter((F.col("community") == F.col("first.community"))
                | (2 * F.col("m") * F.col("w") > F.col("own") * (F.col("its") + F.col("all"))))
        .select("repo_id", "community", "to", "own", "its"))
    grown = joining.groupBy("repo_id", "to").agg((F.sum("own") + F.max("its")).alias("k"))
    moved = skew_join(joining.select("repo_id", "community", "to"), grown, ["repo_id", "to"])
    return written(moved.select("repo_id", "community", "to", "k")
                       .unionByName(grown.select("repo_id", F.col("to").alias("community"), "to", "k")))


def modular_communities(edges: DataFrame) -> DataFrame:
    """Communities of high modularity by merging along edges: ``repo_id, node, community``.

    Every node starts alone. In each round a community picks the neighbour whose merge raises the modularity most, ties by
    name. A hash of name and round makes half of them ask and the others receive. The best that asks is taken, and so is
    everyone whose merge would still pay if all who ask were in already; so each round raises the sum whatever happens at
    the same time. Merged communities become one node of a smaller edge table; no pair that gains ends the search. Gains are
    whole numbers (edges of a repository below a billion). All steps are joins and grouped sums, so a hub is combined
    before the exchange. A connected component that would score as high in one piece stays whole: the result is never worse
    than ``connected_communities``. A community has the name of one of its nodes; repeated and reversed edges count once;
    an empty edge table gives no rows.
    """
    links = written(_undirected(edges))
    degree = written(_undirected_degrees(links))
    total = links.groupBy("repo_id").agg(F.count(F.lit(1)).alias("m"))
    side = lambda own: degree.select("repo_id", F.col("node").alias(own), F.col("_d").alias("k" + own))
    ties = skew_join(skew_join(links.filter("a <> b").withColumn("w", F.lit(1).cast("long")), side("a"), ["repo_id", "a"]),
                     side("b"), ["repo_id", "b"])
    ties = written(skew_join(ties, total, ["repo_id"]))
    members = degree.select(*NODE, F.col("node").alias("community"))
    turn = 0
    while True:
        best = _best_partners(ties)
        if _empty(best):
            break
        while True:  # the pair with the largest gain of all picks each other, so some turn parts it
            asks = lambda name: F.pmod(F.xxhash64(F.concat(F.lit(f"{turn}:"), F.col(name))), F.lit(2)) == 0
            asking = best.filter(asks("community") & ~asks("to"))
            turn += 1
            if not _empty(asking):
                break
        merges = _merges(asking)
        for own in ("a", "b"):
            to = merges.select("repo_id", F.col("community").alias(own), F.col("to").alias("_to"), F.col("k").alias("_k"))
            ties = (skew_join(ties, to, ["repo_id", own], "left")
                    .withColumns({own: F.coalesce("_to", own), "k" + own: F.coalesce("_k", "k" + own)}).drop("_to", "_k"))
        swap = F.col("a") > F.col("b")
        flip = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
        ties = written(
            ties.filter("a <> b")
            .select("repo_id", flip("a", "b"), flip("b", "a"), flip("ka", "kb"), flip("kb", "ka"), "w", "m")
            .groupBy("repo_id", "a", "b", "ka", "kb", "m").agg(F.sum("w").alias("w")))
        members = written(skew_join(members, merges.select("repo_id", "community", "to"), ["repo_id", "community"], "left")
                              .select(*NODE, F.coalesce("to", "community").alias("community")))
    whole = written(connected_communities(edges))
    score = 4 * F.col("_m") * F.col("_inner") - F.col("_degree") * F.col("_degree")
    one = community_scores(links.toDF("repo_id", "src", "dst"), whole).select(
        "repo_id", F.col("community").alias("_whole"), score.alias("_one"))
    # A community is named after one of its nodes, so that node's component is the community's.
    home = whole.select("repo_id", F.col("node").alias("community"), F.col("community").alias("_whole"))
    parts = (community_scores(links.toDF("repo_id", "src", "dst"), members).withColumn("_part", score)
             .join(home, ["repo_id", "community"]).groupBy("repo_id", "_whole").agg(F.sum("_part").alias("_parts")))
    kept = one.join(parts, ["repo_id", "_whole"]).filter("_one >= _parts").select("repo_id", "_whole", F.lit(True).alias("_kept"))
    rows = members.join(whole.withColumnRenamed("community", "_whole"), NODE)
    return (skew_join(rows, kept, ["repo_id", "_whole"], "left")
            .select(*NODE, F.when(F.col("_kept"), F.col("_whole")).otherwise(F.col("community")).alias("community")))


def graph_metadata(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None,
                   communities: DataFrame | None = None) -> DataFrame:
    """Nodes, distinct edges, edges per node, and where given component count and modularity."""
    n = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_modules"))
    e = (edges.select("repo_id", "src", "dst").distinct()
         .groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_dependencies")))
    rows = n.join(e, "repo_id", "left").fillna(0, ["total_dependencies"]).withColumn(
        "avg_dependencies", F.col("total_dependencies") / F.greatest("total_modules", F.lit(1)))
    if components is not None:
        groups = components.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("_n"))
        merged = groups.groupBy("repo_id").agg(F.sum(F.col("_n") - 1).alias("_merged"))
        rows = rows.join(merged, "repo_id", "left").withColumn(
            "strongly_connected_components",
            F.col("total_modules") - F.coalesce("_merged", F.lit(0))).drop("_merged")
    if communities is not None:
        rows = (rows.join(modularity(edges, communities), "repo_id", "left")
                .withColumn("modularity", F.coalesce("modularity", F.lit(0.0))))
    return rows


def code_map(blocks: DataFrame, files: DataFrame) -> CodeMap:
    """Nodes, connections and metadata of the import graph."""
    edges = written(import_edges(blocks, files))  # read by all three parts, several times
    nodes = module_nodes(edges, parsed_modules(blocks, files))
    return CodeMap(colored_nodes(nodes, edges), module_connections(edges),
                   graph_metadata(nodes, edges, strongly_connected(edges), folder_communities(edges)))


def class_listing(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Every class with its number of direct methods and its line."""
    rows = blocks.filter(F.col("kind").isin("class", "inner_class"))
    return sized_join(with_sha(files).select(*FILE, "content_sha"), rows, "content_sha").select(
        *FILE, "name", F.col("n_methods").alias("methods"), F.col("lineno").alias("line_number"))


def function_listing(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Every function that is not async, nested ones and methods included."""
    rows = blocks.filter(F.col("kind").isin("function", "method", "inner") & ~F.col("is_async"))
    return sized_join(with_sha(files).select(*FILE, "content_sha"), rows, "content_sha").select(
        *FILE, "name", F.col("n_args").alias("args"), F.col("lineno").alias("line_number"))


def module_details(blocks: DataFrame, files: DataFrame, modified: DataFrame | None = None) -> DataFrame:
    """One record per file that parses. Lists are bounded by the text of the one file.

    ``modified``: repo_id, file_path, last_modified.
    """
    kind = F.col("kind")
    per_text = blocks.groupBy("content_sha").agg(
        F.max(F.when(kind == "module", F.col("endline"))).alias("size"),
        F.array_sort(F.collect_list(F.when(kind.isin("class", "inner_class"), F.struct(
            F.col("lineno").alias("line_number"), "name", F.col("n_methods").alias("methods"))))).alias("classes"),
        F.array_sort(F.collect_list(F.when(kind.isin("function", "method", "inner") & ~F.col("is_async"), F.struct(
            F.col("lineno").alias("line_number"), "name", F.col("n_args").alias("args"))))).alias("functions"),
        F.array_sort(F.collect_set(F.when(kind == "import", F.col("name")))).alias("dependencies"),
        F.sum(F.when(kind == "function", F.col("complexity")).otherwise(0)).cast("double").alias("complexity"))
    rows = skew_join(with_sha(files).select(*FILE, "content_sha"), per_text.hint("merge"), ["content_sha"])
    if modified is None:
        rows = rows.withColumn("last_modified", F.lit(None).cast("string"))
    else:
        rows = sized_join(rows, modified.select(*FILE, "last_modified"), FILE, "left")
    return rows.select(*FILE, basename(F.col("file_path")).alias("name"), "size", "classes", "functions",
                       "dependencies", "complexity", "last_modified")
