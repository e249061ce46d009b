"""Canonical tables derived by Spark from the provided parquet tables.

``checks_*.py`` states the same mapping in SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rules import author_label
from ..operators.history import chronological_parents
from ..session import configure

# Fixed values of the mapping.
MESSAGES = ("Add feature flag", "Fix bug in loader", "Refactor: extract helper", "Update docs",
            "Refactor rename fields", "Optimize query speed", "Refactor: move module",
            "Secure token check", "Refactor inline loop", "Tidy build", "Patch release notes",
            "Implement parser")
TOP_FOLDERS = ("app", "core", "docs", "tests", "ui", "ai", "ci")
SUB_FOLDERS = ("api", "svc", "util")
ENDINGS = (".py", ".js", ".java", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)


def _text(c: Column) -> Column:
    return c.cast("string")


def _repo(key: Column, n: int) -> Column:
    return F.concat(F.lit("repo"), _text(key % n))


def commits(spark: SparkSession, sf_dir: str, n: int = 50, parents: bool = False) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.lit("dev"), _text(key % 7))
    email = F.concat(name, F.lit("@example.org"))
    rows = table(spark, sf_dir, "orders").select(
        _repo(F.col("o_custkey"), n).alias("repo_id"), key.alias("commit_hash"),
        F.lit(None).cast("long").alias("parent_hash"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
        name.alias("author_name"), email.alias("author_email"), author_label(name, email).alias("author"),
        _pick(MESSAGES, key % 12).alias("message"))
    return chronological_parents(rows) if parents else rows


def file_changes(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """One row per commit and path. A path is spelled out once its key is counted, not before."""
    k = F.col("k")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_hash"), (F.col("l_partkey") % 97).alias("k"),
        F.col("l_quantity").cast("long").alias("ins"),
        (F.round(F.col("l_discount") * 100).cast("long") + F.col("l_linenumber")).alias("del"),
        (F.col("l_partkey") % 31).alias("cb"), (F.col("l_suppkey") % 41).alias("ca"))
    owner = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit_hash"), (F.col("o_custkey") % n).alias("repo"))
    totals = (lines.join(owner, "commit_hash").groupBy("repo", "commit_hash", "k")
              .agg(F.sum("ins").alias("insertions"), F.sum("del").alias("deletions"),
                   F.max("cb").alias("before"), F.max("ca").alias("after")))
    nested = F.concat(_pick(TOP_FOLDERS, k % 7), F.lit("/"), _pick(SUB_FOLDERS, k % 3),
                      F.lit("/file_"), _text(k), _pick(ENDINGS, k % 4))
    path = F.when(k % 13 == 0, F.concat(F.lit("file_"), _text(k), F.lit(".md"))).otherwise(nested)
    return totals.select(
        F.concat(F.lit("repo"), _text(F.col("repo"))).alias("repo_id"), "commit_hash", path.alias("file_path"),
        "insertions", "deletions", F.col("before").cast("double").alias("complexity_before"),
        F.col("after").cast("double").alias("complexity_after"),
        (F.col("insertions") + F.col("deletions")).alias("lines"))


def gappy_file_changes(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """The same touches with some sides missing: added and deleted files, unreadable versions."""
    k = F.col("commit_hash") % 11
    hide = lambda name, i: F.when(k != i, F.col(name)).alias(name)
    rows = file_changes(spark, sf_dir, n)
    return rows.select("repo_id", "commit_hash", "file_path", "insertions", "deletions", "lines",
                       hide("complexity_before", 3), hide("complexity_after", 5))


def head_files(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    return file_changes(spark, sf_dir, n).select("repo_id", "file_path").distinct()


def importance(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """Message importance per commit: the norm of the vector its key points at."""
    from ..functions.vectors import l2_norm
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("_vec"), l2_norm(F.col("embedding")).alias("importance"))
    # Every vector is somebody's: the modulus is the number of vectors.
    total = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()
    return (commits(spark, sf_dir, n)
            .select("repo_id", "commit_hash", F.try_mod(F.col("commit_hash"), total).alias("_vec"))
            .join(vectors, "_vec").select("repo_id", "commit_hash", "importance"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, one repository per language."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("repo_id"),
        F.concat(F.lit("src"), _text(F.col("doc_id")), F.lit(".py")).alias("file_path"),
        F.col("text").alias("content"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python module per part; its key fixes how many branches it has and which module it imports.

    Blocks of eight modules of a repository hold an import cycle of one to seven and a tail into it.
    """
    k = F.col("p_partkey").cast("long")
    block, place = F.floor(k / 80), F.floor(k / 10) % 8
    size = 1 + block % 7
    t = 10 * (block * 8 + F.when(place < size, (place + 1) % size).otherwise(place - 1)) + k % 10
    content = F.concat(
        F.lit("import lib"), _text(k % 5), F.lit(".core, util"), _text(k % 3), F.lit("\n"),
        F.lit("from pkg"), _text(t % 100 % 7), F.lit(".mod_"), _text(t),
        F.lit(" import run\nfrom . import local\n\n\n"),
        F.lit("def run(a, b):\n"), F.repeat(F.lit("    if a > b:\n        a -= 1\n"), (k % 23).cast("int")),
        F.lit("    return a\n\n\n"),
        F.lit("class Box:\n    def get(self):\n        return 1 if self.v else 0\n\n"),
        F.lit("    def put(self, x, y):\n        self.v = x and y or self.v\n"))
    broken = F.when(k % 29 == 0, F.concat(F.lit("def broken(:\n"), content)).otherwise(content)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("repo"), _text(k % 10)).alias("repo_id"),
        F.concat(F.lit("pkg"), _text(k % 100 % 7), F.lit("/mod_"), _text(k), F.lit(".py")).alias("file_path"),
        broken.alias("content"))


def blobs(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """One file version per commit; every thirteenth cannot be read (null content)."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("def run(a, b):\n"),
                    F.repeat(F.lit("    if a > b:\n        a -= 1\n"), (k % 23).cast("int")),
                    F.lit("    return a\n"))
    content = F.when(k % 13 != 0, body)
    return table(spark, sf_dir, "orders").select(
        _repo(F.col("o_custkey"), n).alias("repo_id"), k.alias("commit_hash"),
        F.lit("pkg/main.py").alias("file_path"), F.sha2(content, 256).alias("content_sha"),
        content.alias("content"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the web pages as edges; a page is named by its key."""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("site"), _text(F.col("page_id") % 4)).alias("repo_id"),
        F.concat(F.lit("/page/"), _text(F.col("page_id"))).alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"),
        F.lit("import").alias("type"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per part. Blocks of eight keys hold a cycle of one to seven nodes and a tail that runs into it;
    the last key of a block also leads on to the next, three blocks in a row."""
    k = F.col("p_partkey").cast("long")
    block, place = F.floor(k / 8), k % 8
    size = 1 + block % 7
    inside = block * 8 + F.when(place < size, (place + 1) % size).otherwise(place - 1)
    node = lambda c: F.concat(F.lit("m"), F.lpad(_text(c), 9, "0"))
    repo = F.concat(F.lit("repo"), _text(F.floor(block / 3) % 2)).alias("repo_id")
    rows = table(spark, sf_dir, "part")
    one = rows.select(repo, node(k).alias("src"), node(inside).alias("dst"), F.lit("import").alias("type"))
    on = rows.filter((place == 7) & (block % 3 != 2)).select(
        repo, node(k).alias("src"), node(block * 8 + 8).alias("dst"), F.lit("import").alias("type"))
    return one.unionByName(on)
