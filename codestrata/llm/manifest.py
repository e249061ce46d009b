"""Merkle manifest of a table: a tree per part, a tree over the parts, and proofs by pointer jumping."""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..operators.grouping import skew_join
from .common import stored

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Key of the tree over the parts; keys of parts are empty or begin with ``=``.
TOP = "^"
SEGMENTS = "array<struct<left:binary,right:binary>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def part_key(part: Column) -> Column:
    """Text that is never null and sorts as the part does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``idx`` of every row inside its ``part``, from 0 in the given order, and ``n``, the size of the part.

    Rows are dealt by range and sorted once; the counts by part and range, at most one row per range
    and part, give each range its first place. Rows that agree in the whole order are dealt by their
    place in the input, so that no number of equal rows stays in one range.
    """
    keys = ["part", *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop("_row").withColumn("_range", F.spark_partition_id())
                   .withColumn("_at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("part", "_range").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    every = W.partitionBy("part")
    starts = sizes.select("part", "_range", F.sum("_c").over(every).alias("n"), (
        F.sum("_c").over(every.orderBy("_range")) - F.col("_c") - F.col("_first")).alias("_shift"))
    return (skew_join(dealt, starts, ["part", "_range"])
            .withColumn("idx", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift"))


def height(n: int | None) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n and n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climb(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges to the parents, roots and height of the trees over ``part, idx, n, digest, item``.

    An edge holds the digests left and right of the node in its run. One exchange per level, each an
    eighth of the one before.
    """
    levels = height(leaves.agg(F.max("n")).first()[0])
    nodes, edges, roots = leaves, None, None
    for level in range(levels):
        done = nodes.filter("n = 1").select("part", F.lit(level).alias("level"), "digest")
        roots = done if roots is None else roots.unionByName(done)
        runs = stored(nodes.filter("n > 1").groupBy("part", F.expr(f"idx div {FAN}").alias("parent"), "n").agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest", "item"))).alias("run"))
            .withColumn("digests", F.transform("run", lambda c: c["digest"])))
        joined = lambda part: F.unhex(F.array_join(part, ""))
        step = runs.select("part", "parent", "n", "digests", F.posexplode("run").alias("_p", "_c")).select(
            "part", F.lit(level).alias("level"), F.col("_c")["idx"].alias("idx"), F.lit(level + 1).alias("up_level"),
            F.col("parent").alias("up_idx"), F.col("_c")["digest"].alias("digest"), F.col("_c")["item"].alias("item"),
            F.array(F.struct(joined(F.slice("digests", F.lit(1), F.col("_p"))).alias("left"),
                             joined(F.slice("digests", F.col("_p") + 2, F.lit(FAN))).alias("right"))).alias("segments"),
            F.when(F.col("n") <= FAN, F.sha2(F.array_join("digests", ""), 256)).alias("top"))
        edges = step if edges is None else edges.unionByName(step)
        nodes = runs.select("part", F.col("parent").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"),
                            F.sha2(F.array_join("digests", ""), 256).alias("digest"),
                            F.lit(None).cast(leaves.schema["item"].dataType).alias("item"))
    last = nodes.filter("n = 1").select("part", F.lit(levels).alias("level"), "digest")
    return edges, last if roots is None else roots.unionByName(last), levels


def proofs(docs: DataFrame, tampered: dict[str, Column] | None = None, fields=FIELDS, part: str = "lang",
           key: str = "doc_id") -> DataFrame:
    """``key, leaf, subroot, root, proof, tampered_leaf`` of every row.

    Each row is a leaf, the digest of its ``fields``. Inside a part, leaves ascend by ``key`` (null first; equal
    keys by digest) and every eight consecutive nodes become their digest until one remains, the subroot; subroots,
    ordered by part (null first, UTF-8 bytewise), likewise give the root. ``proof`` is the array of segments from the
    leaf to the root, each with the digests left and right of the node in its run. ``tampered`` replaces columns before
    a second leaf digest is taken; it is null where the replacement changes nothing.

    Proofs come by pointer jumping: a node holds the segments towards an ancestor, and each self-join
    with the ancestors' own rows doubles the distance, so ten levels take four joins. Texts are hashed where they are
    read and never move. Nulls in any field are hashed as ``-``; repeated rows are leaves each; an empty table gives no
    rows; other columns are ignored.
    """
    leaf = leaf_digest(*[F.col(f) for f in fields])
    other = leaf_digest(*[(tampered or {}).get(f, F.col(f)) for f in fields]) if tampered else F.lit(None).cast("string")
    changed = [F.coalesce(~F.col(f).eqNullSafe(c), F.lit(True)) for f, c in (tampered or {}).items()]
    for c in changed[1:]:
        changed[0] = changed[0] | c
    rows = docs.select(part_key(F.col(part)).alias("part"), F.col(key).alias("_key"), leaf.alias("digest"),
                       (F.when(changed[0], other) if changed else other).alias("_other"))
    # Stored before the ranges are sampled, so that texts are read and hashed once.
    rows = placed(stored(rows), ["_key", "digest"]).select(
        "part", "idx", "n", "digest", F.struct(F.col("_key").alias("key"), F.col("_other").alias("other")).alias("item"))
    leaves = stored(rows)
    edges, subroots, low = climb(leaves)
    kind = leaves.schema["item"].dataType
    tops = subroots.select(F.lit(TOP).alias("part"), F.col("part").alias("_of"), F.col("level").alias("_level"),
                           "digest")
    tops = stored(placed(tops, ["_of"]))
    above, roots, high = climb(tops.select("part", "idx", "n", "digest", F.lit(None).cast(kind).alias("item")))
    empty = F.expr(f"cast(array() as {SEGMENTS})")
    none = F.lit(None).cast("string")
    # A subroot's node goes on as a leaf of the tree over the parts.
    links = tops.select(
        F.col("_of").alias("part"), F.col("_level").alias("level"), F.lit(0).cast("long").alias("idx"),
        F.lit(TOP).alias("up_part"), F.lit(0).alias("up_level"), F.col("idx").alias("up_idx"), "digest",
        F.lit(None).cast(kind).alias("item"), empty.alias("segments"), F.col("digest").alias("subroot"),
        F.when(F.col("n") == 1, F.col("digest")).alias("root"))
    # A part of one leaf has no edge of its own: its leaf hangs on the link.
    lone = leaves.filter("n = 1").select(
        "part", F.lit(-1).alias("level"), "idx", F.col("part").alias("up_part"), F.lit(0).alias("up_level"),
        F.lit(0).cast("long").alias("up_idx"), "digest", "item", empty.alias("segments"), none.alias("subroot"),
        none.alias("root"))
    jump = links.unionByName(lone)
    for step, root in ((edges, none), (above, F.col("top"))):
        if step is not None:
            jump = jump.unionByName(step.select(
                "part", "level", "idx", F.col("part").alias("up_part"), "up_level", "up_idx", "digest", "item",
                F.col("segments").cast(SEGMENTS).alias("segments"), none.alias("subroot"), root.alias("root")))
    done = (F.col("up_part") == TOP) & (F.col("up_level") == high)
    keys = ["up_part", "up_level", "up_idx"]
    for _ in range((max(low, 1) + high).bit_length()):  # the longest way has one edge more
        jump = stored(jump)
        # Only inner nodes are ancestors; they have no item.
        inner = jump.filter("item is null").select(
            F.col("part").alias("up_part"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"),
            *[F.col(c).alias(f"_{c}") for c in (*keys, "segments", "subroot", "root")])
        far = skew_join(jump.filter(~done), inner, keys, "left").select(
            "part", "level", "idx", *[F.coalesce(f"_{k}", k).alias(k) for k in keys], "digest", "item",
            F.concat("segments", F.coalesce("_segments", empty)).alias("segments"),
            F.coalesce("subroot", "_subroot").alias("subroot"), F.coalesce("root", "_root").alias("root"))
        jump = far.unionByName(jump.filter(done))
    return jump.filter("item is not null").select(
        F.col("item")["key"].alias(key), F.col("digest").alias("leaf"), "subroot", "root",
        F.col("segments").alias("proof"), F.col("item")["other"].alias("tampered_leaf"))


def folded(leaf: Column, proof: Column) -> Column:
    """Root that follows from a leaf and its proof; a level at which the node stood alone hashes it alone."""
    text = lambda b: F.lower(F.hex(b))
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(text(s["left"]), d, text(s["right"])), 256))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def verified(proved: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified``: proofs against the stored root.

    The tampered leaf, if there is one, is folded in place of the leaf; the siblings stay as stored.
    """
    siblings = F.array_join(F.transform("proof", lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")
    fold = folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof"))
    return proved.select(key, "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                         fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
