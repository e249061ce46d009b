"""Graph operators against brute force and known answers."""

import itertools
import random

from pyspark.sql import functions as F

from codestrata.operators import graph as G
from tests.conftest import plan_of, rows


def edges(spark, pairs, repo="r"):
    return spark.createDataFrame([(repo, a, b, "import") for a, b in pairs],
                                 "repo_id string, src string, dst string, type string")


def brute_components(pairs):
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def brute_cycles(pairs, longest):
    have, nodes, found = set(pairs), sorted({n for p in pairs for n in p}), set()
    for size in range(1, longest + 1):
        for combo in itertools.permutations(nodes, size):
            if combo[0] == min(combo) and all((combo[i], combo[(i + 1) % size]) in have for i in range(size)):
                found.add(combo)
    return found


SETS = {
    "triangle": [("a", "b"), ("b", "c"), ("c", "a")],
    "loop": [("a", "a"), ("a", "b")],
    "two cycles sharing a node": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")],
    "dag": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
    "hub": [("h", f"n{i}") for i in range(15)] + [(f"n{i}", "h") for i in range(0, 15, 3)],
}


def test_components_of_known_graphs(spark):
    for repo, pairs in SETS.items():
        df = edges(spark, pairs, repo)
        labels = G.component_labels(df, G.strongly_connected(df))
        assert dict(rows(labels, "node", "component")) == brute_components(pairs), repo


def test_components_of_random_graphs(spark):
    rng, all_rows, expected = random.Random(7), None, {}
    for i, size in enumerate((12, 20, 30)):
        pairs = sorted({(f"n{rng.randrange(size):02}", f"n{rng.randrange(size):02}") for _ in range(int(size * 1.5))})
        expected |= {(f"g{i}", n): c for n, c in brute_components(pairs).items()}
        df = edges(spark, pairs, f"g{i}")
        all_rows = df if all_rows is None else all_rows.unionByName(df)
    labels = G.component_labels(all_rows, G.strongly_connected(all_rows))
    assert {(r["repo_id"], r["node"]): r["component"] for r in labels.collect()} == expected


def test_cycles(spark):
    rng = random.Random(3)
    sets = dict(SETS, random=sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(16)}))
    sets.pop("hub")
    for repo, pairs in sets.items():
        df = edges(spark, pairs, repo)
        for parts in (None, G.strongly_connected(df)):
            got = {tuple(r["cycle"]) for r in G.circular_dependencies(df, parts, 4).collect()}
            assert got == brute_cycles(pairs, 4), repo


def test_modularity_of_two_triangles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d"), ("d", "c")]
    df = edges(spark, pairs)
    parts = spark.createDataFrame([("r", n, "x" if n in "abc" else "y") for n in "abcdef"],
                                  "repo_id string, node string, community string")
    assert abs(G.modularity(df, parts).collect()[0]["modularity"] - 5 / 14) < 1e-12
    assert dict(rows(G.connected_communities(df), "node", "community")) == dict.fromkeys("abcdef", "a")


def test_connected_communities_of_a_chain_and_stars(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    star = [("h", f"s{i:02}") for i in range(20)]
    found = dict(rows(G.connected_communities(edges(spark, chain + star + [("x", "x")])), "node", "community"))
    assert found == {n: "c000" for p in chain for n in p} | {n: "h" for p in star for n in p} | {"x": "x"}


def test_a_cycle_of_six_is_found(spark):
    six = [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]
    found = G.circular_dependencies(edges(spark, six + [("n0", "out")])).collect()
    assert [r["cycle"] for r in found] == [[f"n{i}" for i in range(6)]]


def test_a_long_ring_takes_few_jobs(spark, monkeypatch):
    """Ten thousand modules in one ring, shuffled names, few steps; a chain beside it has no component."""
    order = list(range(10_000))
    random.Random(2).shuffle(order)
    ring = [(f"n{a:05}", f"n{b:05}") for a, b in zip(order, order[1:] + order[:1])]
    steps, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df: steps.append(1) or write(df))
    found = G.strongly_connected(edges(spark, ring + [(f"c{i}", f"c{i + 1}") for i in range(40)]))
    assert found.groupBy("component").count().collect() == [("n00000", 10_000)]
    assert len(steps) <= 60


def test_paths_that_cannot_come_back_are_not_extended(spark):
    """Start ``b`` leads into a wide lattice of larger nodes that leaves for ``a`` only: no way home without ``a``."""
    layers = [[f"x{i}{j}" for j in "pq"] for i in range(6)]
    lattice = [(u, v) for one, two in zip(layers, layers[1:]) for u in one for v in two]
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("b", "x0p"), ("b", "x0q")] + lattice + [("x5p", "a"), ("x5q", "a")]
    df = edges(spark, pairs)
    home = G.ways_home(df.select("repo_id", "src", "dst"))
    assert {r["last"] for r in home.filter("start = 'b'").collect()} == {"c"}
    assert dict(rows(home.filter("start = 'a' AND last LIKE 'x5%'"), "last", "hops")) == {"x5p": 1, "x5q": 1}
    found = [tuple(r["cycle"]) for r in G.circular_dependencies(df).collect()]
    assert len(found) == len(set(found)) == 2 ** 6 + 1 and ("b", "c") in found
    assert G.ways_home(df.select("repo_id", "src", "dst"), 3).agg(F.max("hops")).collect()[0][0] == 2


def test_degrees_count_distinct_edges(spark):
    df = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")])
    assert rows(G.degrees(df), "node", "in_degree", "out_degree") == [("a", 0, 1), ("b", 1, 1), ("c", 2, 1)]
    wide = edges(spark, SETS["hub"])
    assert rows(G.high_coupling(wide), "node", "in_degree", "out_degree") == [("h", 5, 15)]


def test_metadata(spark):
    df = edges(spark, SETS["triangle"] + [("c", "d")])
    m = G.graph_metadata(G.graph_nodes(df), df, G.strongly_connected(df), G.folder_communities(df)).collect()[0]
    assert (m["total_modules"], m["total_dependencies"], m["avg_dependencies"], m["strongly_connected_components"]) == (4, 4, 1.0, 2)
    assert abs(m["modularity"]) < 1e-12


def test_nodes_prefer_the_file_size(spark):
    files = spark.createDataFrame([("r", "a.py", 40), ("r", "alone.py", 3)], "repo_id string, file_path string, size long")
    nodes = G.module_nodes(edges(spark, [("a.py", "os"), ("b.py", "a.py")]), files)
    assert rows(nodes, "node", "size") == [("a.py", 40), ("alone.py", 3), ("b.py", 1), ("os", 1)]
    colored = G.colored_nodes(nodes, edges(spark, [("a.py", "os")]))
    assert colored.filter(F.col("color").rlike("^#[0-9a-f]{6}$")).count() == 4


def brute_score(pairs, community):
    links = {tuple(sorted(p)) for p in pairs}
    m, total = len(links), 0.0
    for c in set(community.values()):
        degree = sum((community[a] == c) + (community[b] == c) for a, b in links)
        total += sum(community[a] == c == community[b] for a, b in links) / m - (degree / (2 * m)) ** 2
    return total


def test_modular_communities(spark):
    """Known best partitions, random graphs never below their components, and the score itself by brute force."""
    rng = random.Random(5)
    sets = {
        "triangles": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d"), ("d", "c")],
        "cliques": [(f"{i}{x}", f"{i}{y}") for i in range(4) for x, y in itertools.combinations("abcd", 2)]
        + [(f"{i}a", f"{(i + 1) % 4}b") for i in range(4)],
        "star": [("hub", f"l{i:02}") for i in range(40)],
        "loop": [("x", "x")],
        "random": sorted({(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(35)}),
    }
    df = None
    for repo, pairs in sets.items():
        one = edges(spark, pairs, repo)
        df = one if df is None else df.unionByName(one)
    parts = G.modular_communities(df)
    found, whole = {}, {}
    for table, into in ((parts, found), (G.connected_communities(df), whole)):
        for r in table.collect():
            into.setdefault(r["repo_id"], {})[r["node"]] = r["community"]
    for repo, pairs in sets.items():
        assert set(found[repo]) == {n for p in pairs for n in p}, repo
        assert brute_score(pairs, found[repo]) >= brute_score(pairs, whole[repo]) - 1e-12, repo
        assert all(whole[repo][n] == whole[repo][c] for n, c in found[repo].items()), repo
    assert abs(brute_score(sets["triangles"], found["triangles"]) - 5 / 14) < 1e-12
    assert len({frozenset(n for n in found["cliques"] if found["cliques"][n] == c) for c in found["cliques"].values()}) == 4
    assert all(found["cliques"][f"{i}a"] == found["cliques"][f"{i}{x}"] for i in range(4) for x in "bcd")
    assert len(set(found["star"].values())) == 1
    scores = {r["repo_id"]: r["modularity"] for r in G.modularity(df, parts).collect()}
    assert all(abs(scores[repo] - brute_score(pairs, found[repo])) < 1e-12 for repo, pairs in sets.items())
    assert G.modular_communities(df.limit(0)).isEmpty()


def test_no_step_of_components_and_cycles_passes_a_table_through_the_driver(spark, monkeypatch):
    plans, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df: plans.append(plan_of(df)) or write(df))
    df = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d")])
    assert {tuple(c) for c, in rows(G.circular_dependencies(df), "cycle")} == {("a", "b", "c"), ("d", "e")}
    assert plans and not [p for p in plans if "Broadcast" in p]
    parts = G.component_labels(df, G.strongly_connected(df))
    assert "Broadcast" not in plan_of(parts)
    # Only the one row per repository may be handed on.
    scores = plan_of(G.community_scores(df, parts.withColumnRenamed("component", "community")))
    assert scores.count("BroadcastHashJoin") <= 1


def test_nodes_whose_numbers_meet_are_numbered_anew(spark, monkeypatch):
    number, salts = G._number, []
    monkeypatch.setattr(G, "_number", lambda node, salt: salts.append(salt) or (
        F.length(node).cast("long") if salt == 0 else number(node, salt)))
    df = edges(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c"), (None, "a"), ("a", None)])
    assert dict(rows(G.strongly_connected(df), "node", "component")) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert max(salts) == 1
