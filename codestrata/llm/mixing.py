"""Mix sources to target weights with hash thresholds."""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.grouping import skew_join
from .common import stored

BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights=(5, 2, 1), most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from one row per source (``source, source_size``).

    Sources in code point order (null last) take ``weights`` in turn. Together they get ``share`` of
    all sizes by weight; a target stops at ``most`` times its source's size and the excess is shared
    again by weight. That water level has a closed form: in the order of size over weight, the
    sources up to some point are full and the rest share what is left. One row per source is all
    that is ordered here.
    """
    n = len(weights)
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(n)) + 1)
    order = W.orderBy((F.col("source_size") / F.col("_w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = (sizes.withColumn("_w", weight)
              .withColumn("_all", F.sum("source_size").over(W.partitionBy()))
              .withColumn("_weights", F.sum("_w").over(W.partitionBy()))
              .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most))
              .withColumn("_used", F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    level = (F.col("_all") * F.lit(share) - F.col("_full")) / (F.col("_weights") - F.col("_used"))
    capped = ranked.withColumn("_level", level).withColumn(
        "_open", F.col("_level") * F.col("_w") <= F.col("source_size") * F.lit(most))
    # The first source, in that order, whose share fits sets the level of all after it.
    first = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, 0))
    target = F.when(first.isNull(), F.col("source_size") * F.lit(most)).otherwise(
        F.least(first * F.col("_w"), F.col("source_size") * F.lit(most)))
    return capped.select("source", "source_size", target.alias("target"))


KEYS = ["_s", "_null"]


def hashed(docs: DataFrame, source: Column, doc_id: Column, text: Column) -> DataFrame:
    """The columns of ``docs`` with size, hash and source key; the hash is the upper 60 bits of md5 of the id."""
    h = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return docs.select(*docs.columns, word_count(text).alias("_size"), h.alias("_h"),
                       F.coalesce(source, F.lit("")).alias("_s"), source.isNull().alias("_null"))


def thresholds(keyed: DataFrame, share: float, weights, most: float, bits: int, levels: int) -> DataFrame:
    """``_s, _null, source_size, target, _limits``: one row per source with the threshold of each copy."""
    source = F.when(~F.col("_null"), F.col("_s")).alias("source")
    sizes = keyed.groupBy(*KEYS).agg(F.sum("_size").alias("source_size")).select(source, "source_size")
    targets = source_targets(sizes, share, weights, most).withColumns(
        {"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()})
    # One budget per copy. _low: all hashes under it are in; the bucket that starts there is still open.
    copy = [F.struct(F.lit(k).alias("_k"), F.greatest(F.lit(0.0), F.least(
        F.col("target") - F.col("source_size") * F.lit(float(k - 1)), F.col("source_size").cast("double")))
        .alias("_left"), F.lit(0).cast("long").alias("_low")) for k in range(1, math.ceil(most) + 1)]
    budgets = stored(targets.select(*KEYS, "source_size", "target", F.inline(F.array(*copy))))
    wide = 60
    for level in range(levels):
        wide -= bits
        budgets = budgets.withColumn("_parent", F.shiftright("_low", wide + bits))
        inside = keyed.withColumn("_parent", F.shiftright("_h", wide + bits))
        if level:
            inside = skew_join(inside, budgets.select(*KEYS, "_parent").distinct(), [*KEYS, "_parent"])
        sums = inside.groupBy(*KEYS, "_parent", F.shiftright("_h", wide).alias("_bucket")).agg(
            F.sum("_size").alias("_sum"))
        upto = F.sum("_sum").over(W.partitionBy(*KEYS, "_k").orderBy("_bucket"))
        parts = budgets.join(sums, [*KEYS, "_parent"], "left").withColumn("_upto", upto)
        # The last round takes a bucket of which at least half fits, the rounds before only whole ones.
        part = F.col("_sum") / 2 if level == levels - 1 else F.lit(0.0)
        fits = F.col("_upto") - part <= F.col("_left")
        budgets = stored(parts.groupBy(*KEYS, "source_size", "target", "_k", "_low", "_left").agg(
            F.coalesce(F.min(F.when(~fits, F.col("_bucket"))), F.max("_bucket") + 1).alias("_at"),
            F.coalesce(F.sum(F.when(fits, F.col("_sum"))), F.lit(0)).alias("_in")).select(
            *KEYS, "source_size", "target", "_k", (F.col("_left") - F.col("_in")).alias("_left"),
            F.coalesce(F.shiftleft("_at", wide), F.col("_low")).alias("_low")))
    return budgets.groupBy(*KEYS).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                                      F.collect_list("_low").alias("_limits"))


def copies_of(keyed: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with ``source_size, target, _copies``."""
    return skew_join(keyed, limits, KEYS).withColumn(
        "_copies", F.size(F.filter("_limits", lambda x: F.col("_h") < x)).cast("long"))


def mix(docs: DataFrame, share: float = 1.5, weights=(5, 2, 1), most: float = 2.0, bits: int = BITS,
        levels: int = LEVELS, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source") -> DataFrame:
    """Copies of each document that a mix takes: ``doc_id, source, size, source_size, target, copies``.

    A document with hash h gets copy k of its source while h lies under the k-th threshold. The budgets
    of the copies are nested: copy 1 takes up to the source's whole size, copy 2 what the target leaves.
    Word sums by source and the hash's upper ``bits`` show the bucket in which a budget ends; only the
    rows of that bucket are summed by the next ``bits``, and so on for ``levels`` rounds. In the last
    round the bucket is taken when that comes nearer to the budget. Rows are filtered by comparing
    their hash with the threshold; nothing is sorted, and a source of any size is spread by hash.

    Null text has size 0; a null source is a source of its own; rows that repeat an id share its fate,
    null ids included. Documents of size 0 are taken with their hash like any other. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
                       F.col(text_column).alias("text"))
    keyed = stored(hashed(rows, F.col("source"), F.col("doc_id"), F.col("text")).select("doc_id", "_size", "_h", *KEYS))
    limits = thresholds(keyed, share, weights, most, bits, levels)
    return copies_of(keyed, limits).select(
        "doc_id", F.when(~F.col("_null"), F.col("_s")).alias("source"), F.col("_size").alias("size"),
        "source_size", "target", F.col("_copies").alias("copies"))


def take(docs: DataFrame, share: float = 1.5, weights=(5, 2, 1), most: float = 2.0, bits: int = BITS,
         levels: int = LEVELS) -> DataFrame:
    """The documents that the mix takes, all columns, with ``copies``; a document without a copy goes.

    The thresholds, one row per source, go to the documents; the texts are moved only if there are
    too many sources to broadcast.
    """
    rows = docs.select("source", "doc_id", "text")
    keyed = stored(hashed(rows, F.col("source"), F.col("doc_id"), F.col("text")).select("_size", "_h", *KEYS))
    limits = stored(thresholds(keyed, share, weights, most, bits, levels))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source", "doc_id", "text")
    taken = copies_of(hashed(rows, F.col("source"), F.col("doc_id"), F.col("text")).drop("source", "doc_id", "text"), limits)
    return taken.filter("_copies > 0").select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c != "copies"], F.col("_copies").alias("copies"))
