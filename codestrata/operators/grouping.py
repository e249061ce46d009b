"""Grouping helpers that stay spread out when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TAG = "_tag"


def sized_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join of tables whose size is not known before they are made.

    The planner takes texts, hashes and parsed blocks for a few bytes each and would send a whole table of them through
    the driver to every executor. Here both sides are exchanged and sorted, whatever the estimate says.
    """
    return left.join(right.hint("merge"), keys, how)


def skew_join(big: DataFrame, small: DataFrame, keys, how: str = "inner", keep_tag: bool = False) -> DataFrame:
    """Equi join in which a key of ``big`` may hold a large share of all rows.

    Adaptive execution cuts a hot partition only when both sides were exchanged for the join
    itself. A small side that was aggregated on the keys brings its own partitioning along and
    rules that out, so a hash of the keys joins as one more key: both sides are exchanged, and a
    hot key is spread over many tasks. With ``spark.sql.adaptive.skewJoin.enabled`` off this is
    the plain join, which needs no exchange between bucketed tables.
    """
    keys = list(keys)
    if big.sparkSession.conf.get("spark.sql.adaptive.skewJoin.enabled") != "true":
        joined = big.join(small, keys, how)
        return joined.withColumn(TAG, F.lit(0)) if keep_tag else joined
    tag = F.xxhash64(*keys)
    joined = big.withColumn(TAG, tag).join(small.withColumn(TAG, tag), [*keys, TAG], how)
    return joined if keep_tag else joined.drop(TAG)


def key_filter(small: DataFrame, keys, words: int = 1 << 16) -> Column:
    """Condition that holds for every row whose ``keys`` stand in ``small``, and for few others.

    The keys' hashes set bits in a table of ``64 * words`` bits, half a megabyte at any size of ``small``. It is a
    scalar subquery, so the table is made once when the plan runs and rows are tested where they are scanned, in
    front of the exchange of a join that decides exactly. With many more keys than bits it lets most rows pass.
    """
    h = F.xxhash64(*keys)
    word, bit = F.pmod(h, F.lit(words)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")
    marks = small.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits"))
    every = small.sparkSession.range(words).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    table = (marks.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).unionByName(every)
             .groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"])))
    return F.getbit(F.get(table.scalar(), word.cast("int")), bit) == 1


def nested(rows: DataFrame, keys, item: Column, name: str) -> DataFrame:
    """Exactly one row per key: ``keys, name`` with the sorted array of ``item``.

    For keys that are bounded by nature (the files of one commit, the people of one file). A set that
    grows with the data has a flat table instead.
    """
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))


def newest_commits(commits: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest commits per repository with their rank ``rn`` (1 is the newest).

    Each task keeps at most ``n`` rows per repository before the exchange.
    """
    order = W.partitionBy("repo_id").orderBy(F.col("committed_at").desc(), F.col("commit_hash").desc())
    return commits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def top_per_repo(rows: DataFrame, order, k: int) -> DataFrame:
    """First ``k`` rows per repository in ``order``, with their ``rank``."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def hash_share(df: DataFrame, keys, id_columns, fraction: float, seed: int, flag: str,
               buckets: int = 4096) -> DataFrame:
    """Mark exactly ``floor(fraction * n)`` rows of every key group, chosen by hash.

    The hash is uniform, so its top bits cut each group into even buckets. Counts per bucket
    give the one bucket in which the mark ends; only the rows of that bucket are sorted.
    """
    keys = list(keys)
    hashed = df.withColumn("_h", F.xxhash64(*id_columns, F.lit(seed))).withColumn(
        "_b", F.pmod(F.col("_h"), F.lit(buckets)))
    counts = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by_bucket = W.partitionBy(*keys).orderBy("_b")
    before = F.sum("_c").over(by_bucket) - F.col("_c")
    total = F.sum("_c").over(W.partitionBy(*keys))
    bounds = counts.select(*keys, "_b", before.alias("_before"),
                           F.floor(total * F.lit(fraction)).alias("_target"),
                           F.col("_c"))
    placed = hashed.join(bounds, [*keys, "_b"])
    inside = (F.col("_before") < F.col("_target")) & (F.col("_before") + F.col("_c") > F.col("_target"))
    rank = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", *id_columns))
    edge = (placed.filter(inside).withColumn("_r", rank)
            .withColumn(flag, F.col("_before") + F.col("_r") <= F.col("_target")).drop("_r"))
    rest = (placed.filter(~inside)
            .withColumn(flag, F.col("_before") + F.col("_c") <= F.col("_target")))
    return edge.unionByName(rest).drop("_h", "_b", "_before", "_target", "_c")


def exact_quantiles(df: DataFrame, keys, quantiles: dict[str, tuple[str, float]],
                    bins: int = 4096, levels: int = 2) -> DataFrame:
    """Exact, linearly interpolated quantiles per key.

    ``quantiles`` maps an output name to (column, fraction). Works on value counts of all the
    columns at once. Each level cuts the remaining value range into equal bins, finds the bin
    that holds each wanted rank from the bin counts, and keeps only that bin; the last step
    orders what is left. A window therefore sees at most ``bins`` rows per wanted rank plus the
    distinct values of one final bin.
    """
    keys = list(keys)
    v = F.col("_v")
    columns = sorted({column for column, _ in quantiles.values()})
    melted = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in columns])))
    counts = melted.filter(v.isNotNull()).groupBy(*keys, "_col", "_v").agg(F.count(F.lit(1)).alias("_c"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_q"), F.lit(column).alias("_of"), F.lit(p).alias("_p"),
                                F.lit(end).alias("_end"))
                       for name, (column, p) in quantiles.items() for end in ("below", "above")])
    position = F.col("_p") * (F.col("_n") - 1)
    ranks = (counts.groupBy(*keys, "_col").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"),
                                               F.max("_v").alias("_hi"))
             .select("*", F.inline(wanted)).filter(F.col("_of") == F.col("_col"))
             .select(*keys, "_col", "_q", "_end", "_lo", "_hi", position.alias("_pos"),
                     F.when(F.col("_end") == "below", F.floor(position)).otherwise(F.ceil(position)).alias("_k"),
                     F.lit(0).cast("long").alias("_skip")))
    slot = [*keys, "_q", "_end"]
    rows = skew_join(counts, ranks, [*keys, "_col"])
    for _ in range(levels):
        width = (F.col("_hi") - F.col("_lo")) / bins
        bucket = F.coalesce(F.least(F.floor(F.try_divide(v - F.col("_lo"), width)), F.lit(bins - 1)), F.lit(0))
        rows = rows.withColumn("_bin", F.when(width > 0, bucket).otherwise(F.lit(0)).cast("long"))
        sizes = rows.groupBy(*slot, "_bin").agg(
            F.sum("_c").alias("_bc"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"),
            F.max("_k").alias("_bk"), F.max("_skip").alias("_bskip"))
        before = F.sum("_bc").over(W.partitionBy(*slot).orderBy("_bin")) - F.col("_bc") + F.col("_bskip")
        hit = (sizes.withColumn("_before", before)
               .filter((F.col("_before") <= F.col("_bk")) & (F.col("_bk") < F.col("_before") + F.col("_bc")))
               .select(*slot, "_bin", "_before", "_blo", "_bhi"))
        rows = rows.join(hit, [*slot, "_bin"]).select(
            *slot, "_v", "_c", "_k", "_pos", F.col("_before").alias("_skip"), F.col("_blo").alias("_lo"),
            F.col("_bhi").alias("_hi"))
    upto = F.sum("_c").over(W.partitionBy(*slot).orderBy("_v")) + F.col("_skip")
    ends = (rows.withColumn("_upto", upto)
            .filter((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_c") <= F.col("_k"))))
    pick = lambda name, end: F.max(F.when((F.col("_q") == name) & (F.col("_end") == end), v))
    share = lambda name: F.max(F.when(F.col("_q") == name, F.col("_pos") - F.floor("_pos")))
    return ends.groupBy(*keys).agg(*[
        (pick(name, "below") + (pick(name, "above") - pick(name, "below")) * share(name)).alias(name)
        for name in quantiles])
