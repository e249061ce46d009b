"""Block scoring, imports, duplicates, suggestions and health on hand-written sources."""

from codestrata.operators import graph as G, quality as R
from codestrata.operators.python_source import score_blocks
from tests.conftest import rows

RICH = '''import a.b, c
from m import x
from . import y
from ..pkg.sub import z


def plain(p, q=1, *rest, key=None):
    if p and q or key:
        return 1
    elif q:
        return 2
    for i in range(3):
        pass
    else:
        q = 1
    while p:
        p -= 1
    try:
        q = 1 if p else 2
    except ValueError:
        q = [v for v in rest if v if q]
    except KeyError:
        pass
    else:
        q = 3
    assert q

    def inside(r):
        if r:
            return lambda s: s or r
    return inside


async def later(n):
    match n:
        case 1:
            return 1
        case 2 | 3:
            return 2
        case _:
            return 3


class Box:
    size = 1 if True else 2

    def get(self):
        return self.v if self.v else 0

    async def wait(self):
        async for i in self:
            pass

    class Inner:
        def deep(self):
            pass


class Bare:
    flag = 1 if True else 0
'''


def files(spark, **texts):
    return spark.createDataFrame([("r", f"{k}.py", v) for k, v in texts.items()],
                                 "repo_id string, file_path string, content string")


def test_counting_rule(spark):
    got = {r["name"]: (r["kind"], r["complexity"], r["n_args"], r["n_methods"], r["is_async"])
           for r in score_blocks(files(spark, rich=RICH)).filter("kind not in ('import', 'module')").collect()}
    # plain: 1 + if, elif (2), and/or (2), for + else (2), while, if-expression, two handlers (2),
    # comprehension and its two filters (3), try else, assert = 16
    assert got["plain"] == ("function", 16, 2, 0, False)
    assert got["inside"] == ("inner", 3, 1, 0, False)
    assert got["later"] == ("function", 3, 1, 0, True)
    assert got["get"] == ("method", 2, 1, 0, False) and got["wait"] == ("method", 2, 1, 0, True)
    assert got["Box"] == ("class", 3, 0, 1, False)
    assert got["Inner"] == ("inner_class", 2, 0, 1, False) and got["deep"][0] == "inner"
    assert got["Bare"] == ("class", 2, 0, 0, False)


def test_files_without_blocks(spark):
    df = files(spark, empty="", broken="def (:", nul="a\x00b", flat="x = 1\n", two="def f():\n    pass\n")
    blocks = score_blocks(df)
    assert dict(rows(R.file_complexity(blocks, df), "file_path", "complexity")) == {
        "empty.py": 0.0, "broken.py": 0.0, "nul.py": 0.0, "flat.py": 0.0, "two.py": 1.0}
    assert rows(G.parsed_modules(blocks, df), "file_path", "size") == [("empty.py", 0), ("flat.py", 1), ("two.py", 2)]
    assert R.module_complexity(blocks, df).filter("complexity > 0").count() == 1


def test_imports(spark):
    df = files(spark, rich=RICH, self="import self\nimport self\n")
    got = rows(G.import_edges(score_blocks(df), df), "src", "dst")
    assert got == [("rich.py", "a.b"), ("rich.py", "c"), ("rich.py", "m"), ("rich.py", "pkg.sub"), ("self.py", "self")]


def test_resolved_imports(spark):
    df = spark.createDataFrame([("r", "p/a.py", "import p.b\nimport os"), ("r", "p/b.py", "from p import a\nimport p.a"),
                                ("r", "p/__init__.py", ""), ("s", "p/b.py", "")],
                               "repo_id string, file_path string, content string")
    edges = G.import_edges(score_blocks(df), df)
    assert rows(G.resolve_imports(edges, df), "src", "dst") == [
        ("p/a.py", "p/b.py"), ("p/b.py", "p/__init__.py"), ("p/b.py", "p/a.py")]


def test_copies_are_scored_once_and_known_ones_skipped(spark):
    df = files(spark, **{f"f{i}": "def f(): pass" for i in range(30)}, g="def g(): pass")
    blocks = score_blocks(df)
    assert blocks.filter("kind = 'function'").count() == 2
    assert R.file_complexity(blocks, df).filter("complexity = 1").count() == 31
    assert score_blocks(df, known=blocks).isEmpty()


def test_listings(spark):
    df = files(spark, rich=RICH)
    blocks = score_blocks(df)
    assert rows(G.class_listing(blocks, df), "name", "methods") == [("Bare", 0), ("Box", 1), ("Inner", 1)]
    assert rows(G.function_listing(blocks, df), "name", "args") == [("deep", 1), ("get", 1), ("inside", 1), ("plain", 2)]
    detail = G.module_details(blocks, df).collect()[0]
    assert detail["complexity"] == 19.0 and detail["dependencies"] == ["a.b", "c", "m", "pkg.sub"]


def test_complexity_suggestion(spark):
    df = files(spark, rich=RICH)
    found = R.complexity_suggestions(score_blocks(df), df).collect()
    assert [f["description"] for f in found] == ["Function 'plain' has high cyclomatic complexity (16)"]
    assert found[0]["code_snippet"].startswith("def plain") and found[0]["code_snippet"].endswith("return inside")
    assert found[0]["suggested_changes"].count("\n") == 1


def test_duplicates_overlap_and_count_blank_lines(spark):
    body = "\n".join("abcdef")
    df = files(spark, one=body, two="x\n" + body, blank="\n" * 7, short="a\nb")
    got = rows(R.duplicate_blocks(df), "occurrences", "file_path", "line_no")
    assert got == [(2, "one.py", 1), (2, "one.py", 2), (3, "blank.py", 1)]
    text = {r["line_no"]: r["code_snippet"] for r in R.with_snippet(R.duplicate_blocks(df), df).collect()
            if r["file_path"] == "one.py"}
    assert text == {1: "a\nb\nc\nd\ne", 2: "b\nc\nd\ne\nf"}


def test_duplicates_stay_inside_a_repository(spark):
    df = spark.createDataFrame([(r, "f", "a\nb\nc\nd\ne") for r in "xy"], "repo_id string, file_path string, content string")
    assert R.duplicate_blocks(df).isEmpty()


def test_health_and_order(spark):
    df = files(spark, one="a\nb\nc\nd\ne\n", two="a\nb\nc\nd\ne\n")
    cycles = spark.createDataFrame([("r", ["p", "q"])], "repo_id string, cycle array<string>")
    coupled = spark.createDataFrame([("r", "hub", 9, 2)], "repo_id string, node string, in_degree long, out_degree long")
    found = (R.duplicate_suggestions(df).unionByName(R.cycle_suggestions(cycles))
             .unionByName(R.coupling_suggestions(coupled)))
    assert [(r["priority"], r["file_path"]) for r in R.prioritize(found).collect()] == [(3, "hub"), (3, "p"), (1, "one.py")]
    health = R.code_health(found, df).collect()[0]
    assert (health["n_files"], health["n_suggestions"], health["overall_health"]) == (2, 3, 50.0)
    none = R.code_health(found, df.limit(0)).collect()[0]
    assert none["overall_health"] == 100.0
    assert R.code_health(found.limit(0), df).collect()[0]["overall_health"] == 100.0


def test_a_text_with_many_spans_is_split_once(spark):
    """Twenty thousand overlapping blocks in one file: linear work, or this never ends."""
    text = "\n".join(f"line {i}" for i in range(20_000))
    df = files(spark, a=text, b=text)
    found = R.with_snippet(R.duplicate_blocks(df), df)
    assert found.count() == 19_996
    assert found.filter("code_snippet = 'line 7\nline 8\nline 9\nline 10\nline 11'").count() == 1


def test_worker_functions_travel_with_the_job():
    """Executors have no copy of the package: its functions are pickled whole."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from codestrata.operators.python_source import _rows
    code = "import pickle, sys; print(len(pickle.load(sys.stdin.buffer)('x', 'def f(): pass')))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(_rows), capture_output=True, cwd="/")
    assert done.stdout.strip() == b"2", done.stderr


def test_tables_of_unknown_size_are_not_sent_through_the_driver(spark):
    """The planner takes the texts and their blocks for small: every join of them is by exchange."""
    files = spark.createDataFrame([("r", "a.py", RICH), ("r", "b.py", "import a\n")], "repo_id string, file_path string, content string")
    blocks = score_blocks(files)
    edges = G.import_edges(blocks, files)
    plans = [blocks, edges, G.resolve_imports(edges, files), G.parsed_modules(blocks, files), G.class_listing(blocks, files),
             G.function_listing(blocks, files), G.module_details(blocks, files), R.file_complexity(blocks, files),
             R.module_complexity(blocks, files), R.complexity_suggestions(blocks, files), R.duplicate_suggestions(files)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows(G.class_listing(blocks, files)) and G.module_details(blocks, files).count() == 2
