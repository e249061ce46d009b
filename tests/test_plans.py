"""Plan shapes that must hold at any size."""

import pytest
from pyspark.sql import functions as F

from codestrata.operators import history as H, insights as I, quality as R
from codestrata.operators.grouping import key_filter, newest_commits
from codestrata.plans import workload as X
from codestrata.plans.catalog import QUERIES
from tests.conftest import plan_of, rows


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    """The canonical tables as parquet, as a user would have them."""
    folder = tmp_path_factory.mktemp("tables")
    X.commits(spark, data, parents=True).write.parquet(f"{folder}/commits")
    X.gappy_file_changes(spark, data).write.parquet(f"{folder}/changes")
    return spark.read.parquet(f"{folder}/commits"), spark.read.parquet(f"{folder}/changes")


@pytest.fixture
def no_broadcast(spark):
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    yield
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(key)


def test_no_query_pairs_everything(spark, data):
    # Streams and models run while they are built; their plans read finished results.
    for name, build in QUERIES.items():
        if not name.startswith(("st", "m11", "m13_model", "m14", "g6", "g7", "g14_code_map_m", "g8_prop", "r11", "r13", "r14", "r15")):
            plan = plan_of(build(spark, data))
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_date_filter_and_columns_reach_the_scan(stored):
    c, _ = stored
    plan = plan_of(H.commit_history(c, start="1995-01-01", end="1996-01-01").select("commit_hash"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(committed_at" in scan and "LessThanOrEqual" in scan.split("PushedFilters")[1]
    assert "ReadSchema: struct<commit_hash:bigint,committed_at:timestamp>" in scan


def test_newest_commits_are_limited_before_the_exchange(stored):
    lines = plan_of(newest_commits(stored[0], 200)).splitlines()
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert len(limits) == 2 and limits[0] < exchange < limits[1]


def test_top_alerts_are_limited_before_the_exchange(stored):
    assert plan_of(I.refactor_alerts(H.complexity_trends(*stored))).count("WindowGroupLimit") >= 3


def exchanged(df):
    """Rows that each exchange on keys moved, by the line of the final adaptive plan."""
    df.collect()
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name in ("ResultQueryStageExec", "ShuffleQueryStageExec"):
            stack.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found.append((node.simpleString(500), node.metrics().apply("shuffleRecordsWritten").value()))
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_trends_do_not_shuffle_touches_outside_the_window(spark, stored, threshold):
    """With and without a broadcast of the window, the exchange sees the window's touches alone."""
    commits, touches = stored
    inside = touches.join(newest_commits(commits, 3), ["repo_id", "commit_hash"]).count()
    assert inside < touches.count() / 4
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    for key in keys:
        spark.conf.set(key, threshold)
    try:
        moved = exchanged(H.complexity_trends(commits, touches, 3))
    finally:
        for key, value in zip(keys, before):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert max(n for line, n in moved if "file_path" in line) <= inside * 1.02
    if threshold == "-1":  # the touches themselves are exchanged, for the join
        assert inside <= max(n for line, n in moved if "commit_hash" in line) <= inside * 1.02


def test_the_key_filter_loses_no_key(spark):
    small = spark.range(0, 30_000, 3).select(F.col("id").alias("k"), F.col("id").cast("string").alias("s"))
    big = spark.range(60_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("s"))
    kept = {r["k"] for r in big.filter(key_filter(small, ["k", "s"])).collect()}
    assert set(range(0, 30_000, 3)) <= kept and len(kept) < 10_500
    assert big.filter(key_filter(small.limit(0), ["k", "s"])).isEmpty()


def test_hotspots_shuffle_the_touches_once(stored, no_broadcast):
    plan = plan_of(H.touch_impact(*stored))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Commits, their partial sums, the joined commits for the split join, and the touches.
    assert len(exchanges) == 4


def test_rollup_counts_on_the_join_keys(stored, no_broadcast):
    plan = plan_of(I.subsystem_touches(*stored))
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 4


def test_duplicates_need_one_narrow_exchange(spark, data):
    plan = plan_of(R.duplicate_blocks(X.source_files(spark, data)))
    exchange = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchange) == 1 and "h1" in exchange[0] and "content" not in exchange[0]


def test_results_do_not_depend_on_partitions(spark, data, stored):
    before = (rows(I.refactor_alerts(H.complexity_trends(*stored))), rows(R.duplicate_blocks(X.source_files(spark, data))))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        c, f = (df.repartition(5) for df in stored)
        assert (rows(I.refactor_alerts(H.complexity_trends(c, f))),
                rows(R.duplicate_blocks(X.source_files(spark, data).repartition(3)))) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_repository_with_most_of_the_rows(stored, no_broadcast):
    """A hot repository with one hot file gives the same totals as plain counting."""
    c, f = stored
    hot = F.col("commit_hash") % 3 != 0
    c = c.withColumn("repo_id", F.when(hot, "hot").otherwise(F.col("repo_id")))
    f = (f.withColumn("repo_id", F.when(hot, "hot").otherwise(F.col("repo_id")))
         .withColumn("file_path", F.when(hot, "one.py").otherwise(F.col("file_path")))
         .groupBy("repo_id", "commit_hash", "file_path").agg(
             *[F.sum(n).alias(n) for n in ("insertions", "deletions", "lines")],
             *[F.max(n).alias(n) for n in ("complexity_before", "complexity_after")]))
    local = f.toPandas()
    expected = local.groupby(["repo_id", "file_path"]).size()
    got = H.hotspots(c, f).collect()
    assert {(r["repo_id"], r["file_path"]): r["change_count"] for r in got} == expected.to_dict()
    assert expected["hot", "one.py"] > len(local) / 3
    roll = {(r["repo_id"], r["subsystem"]): r["n"] for r in I.subsystem_rollup(c, f).collect()}
    assert roll["hot", "root"] == expected["hot", "one.py"]


def test_a_commit_with_most_touches_is_split(spark, no_broadcast):
    """One commit holds two thirds of all touches: its join partition is cut, the totals stay whole."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    n = F.col("id")
    commit = F.when(n < 40_000, F.lit(0)).otherwise(n % 500)
    touches = spark.range(0, 60_000, 1, 8).select(
        F.lit("r").alias("repo_id"), commit.cast("string").alias("commit_hash"),
        F.concat(F.xxhash64(n % 6000).cast("string"), F.lit("/f"), n.cast("string")).alias("file_path"),
        F.lit(1).cast("long").alias("insertions"), F.lit(1).cast("long").alias("deletions"))
    commits = spark.range(500).select(
        F.lit("r").alias("repo_id"), n.cast("string").alias("commit_hash"),
        F.timestamp_seconds(n * 3600).alias("committed_at"), F.lit("x").alias("author"), F.lit("fix").alias("message"))
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        df = I.subsystem_rollup(commits, touches)
        assert [r["n"] for r in df.collect()] == [10] * 6000
        assert "SortMergeJoin(skew=true)" in plan_of(df)
    finally:
        for key in small:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_tasks_take_a_bounded_share_of_an_exchange(spark, data):
    """However few cores there are, a task of the history does not take all that an exchange holds."""
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    X.table(spark, data, "orders")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    rows_ = spark.range(2_500_000, numPartitions=2).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        counted = rows_.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        assert counted.rdd.getNumPartitions() > 10  # one per core, 8, without the bound
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
