"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.grouping import skew_join
from .common import least_labels, linked_groups, slices, stored, utf8
from .lines import meetings

SEED = 42
TILE = 16_384
BANDS, DEPTH = 12, 3


def majority(hashes: np.ndarray) -> int:
    """64-bit number whose bits are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def text_fingerprint(text: bytes, words: int = 4) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if len(found) <= words:
        return majority(np.array([digest(b" ".join(found), SEED)], np.uint64)) if found else 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(found) - words + 1].tolist()
    ends = (ends[words - 1:] - 1).tolist()
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def fingerprints(rows: DataFrame, words: int = 4) -> DataFrame:
    """All columns but ``text``, and ``fp``: SimHash of the word shingles of every whole text as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([text_fingerprint(t, words) for t in utf8(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))],
                                             names=[*batch.schema.names[1:], "fp"])

    rows = rows.select("text", *[c for c in rows.columns if c != "text"])
    return rows.mapInArrow(run, rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within ``radius`` bits inside tile ``a``, or between ``a`` and ``b``.

    Every pair is compared. Of the links only a star per connected part is returned, at most one per
    fingerprint, so a large group of near copies costs rows in proportion to its size.
    """
    both = a if b is None else np.concatenate([a, b])
    right = a if b is None else b
    shift = 0 if b is None else len(a)
    bits = both.view(np.uint64)
    label = np.arange(len(both))
    step = max(1, block // max(1, len(right)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(bits[at:at + step, None] ^ right.view(np.uint64)[None, :]) <= radius
        u, v = np.nonzero(near)
        u, v = u + at, v + shift
        keep = u < v
        if keep.any():
            u, v = u[keep], v[keep]
            new = label[u] != label[v]
            if new.any():
                part = least_labels(label[u[new]], label[v[new]], len(both))
                label = part[label]
    linked = np.nonzero(label != np.arange(len(both)))[0]
    return both[linked], both[label[linked]]


def near_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Spanning links ``a, b`` between distinct fingerprints ``fp`` at most ``radius`` bits apart.

    Exact: all tile pairs are compared except those whose population counts prove a larger distance.
    A fingerprint's cell is the population count of its two halves; the difference of two cells bounds
    the distance from below, so a cell meets only the cells within ``radius`` steps. Cells above
    ``tile`` fingerprints are dealt over several tiles by hash; each tile pair is one row of work.
    """
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    cells = fps.select("fp", half(32).alias("p"), half(0).alias("q"))
    counts = cells.groupBy("p", "q").agg(F.ceil(F.count(F.lit(1)) / tile).alias("_tiles"))
    tiles = stored(cells.join(F.broadcast(counts), ["p", "q"])  # at most 33 x 33 rows
                   .withColumn("t", F.pmod(F.xxhash64("fp"), F.col("_tiles")))
                   .groupBy("p", "q", "t").agg(F.collect_list("fp").alias("fps")))
    names = tiles.select("p", "q", "t")
    ahead = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1)
             if i + abs(j) <= radius and (i, j) >= (0, 0)]
    near = names.select(F.struct("p", "q", "t").alias("a"), F.inline(F.array(*[
        F.struct((F.col("p") + i).alias("p"), (F.col("q") + j).alias("q")) for i, j in ahead])))
    pairs = near.join(names, ["p", "q"]).select("a", F.struct("p", "q", "t").alias("b")).filter("a <= b")
    work = (pairs.join(tiles.select(F.struct("p", "q", "t").alias("a"), F.col("fps").alias("left")), "a")
            .join(tiles.select(F.struct("p", "q", "t").alias("b"), F.col("fps").alias("right")), "b")
            .select((F.col("a") == F.col("b")).alias("same"), "left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = batch.column(1)[i].values.to_numpy()
                b = None if batch.column(0)[i].as_py() else batch.column(2)[i].values.to_numpy()
                u, v = tile_links(a, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, tile: int = TILE,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; the SimHash of their word
    shingles (repeats included) links documents at most ``radius`` bits apart, and ``component_id`` is
    the smallest id reachable. A null or empty text has fingerprint 0 and links like any other; a text of
    fewer words is one shingle. Equal fingerprints are one node, so copies cost nothing beyond their
    own row. Null ids never become a component's id (it is null if there is no other); repeated rows are
    kept; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    fps = stored(fingerprints(rows, words))
    rooted = roots(fps, radius, tile).join(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(least, "root").select("fp", "component_id")
    return skew_join(fps, ids, ["fp"]).select("doc_id", "fp", "component_id")


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a text of fewer words is one shingle."""
    import xxhash

    found = text.lower().split()
    parts = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64))


def least_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of ``DEPTH`` least hashes each; two sets agree in a least hash with their Jaccard similarity."""
    odd = np.random.default_rng(17).integers(1, 1 << 62, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.array([(hashes * x).min() for x in odd]).reshape(BANDS, DEPTH)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for d in range(DEPTH):
        keys = (keys ^ least[:, d]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def shingle_links(rows: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Links ``a, b`` between fingerprints of ``fp, text`` rows whose shingle sets have a Jaccard similarity of ``least``.

    Texts that share a key of least hashes are compared exactly, by 64-bit hashes of their shingles.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t, words) for t in utf8(batch, "text")]
            some = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some, pa.int64())), batch.column(1).take(pa.array(some, pa.int64())),
                 pa.array([sets[k].view(np.int64) for k in some], pa.list_(pa.int64())),
                 pa.array([least_keys(sets[k]) for k in some], pa.list_(pa.int64()))],
                names=["line", "fp", "set", "keys"])

    texts = rows.select(F.xxhash64("text").alias("line"), "fp", "text")
    known = stored(texts.mapInArrow(read, "line long, fp long, set array<long>, keys array<long>")
                   .dropDuplicates(["line", "fp"]))
    members = meetings(known.select(F.explode("keys").alias("key"), "line"))
    held = skew_join(members, known.select("line", "fp", "set"), ["line"]).repartition("cluster").sortWithinPartitions(
        "cluster", "line").select("cluster", "fp", "set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, seen = None, []
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                c, fp, own = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy()
                if c != cluster:
                    cluster, seen = c, []
                near = set()
                for group in seen:
                    for other_fp, other in group:
                        if min(len(own), len(other)) >= least * max(len(own), len(other)):
                            both = len(np.intersect1d(own, other, assume_unique=True))
                            if both >= least * (len(own) + len(other) - both):
                                near.add(id(group))
                                out.append((fp, other_fp))
                                break
                joined = [x for group in seen if id(group) in near for x in group] + [(fp, own)]
                seen = [group for group in seen if id(group) not in near] + [joined]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return held.mapInArrow(verify, "a long, b long")


def roots(fps: DataFrame, radius: int, tile: int, more: DataFrame | None = None) -> DataFrame:
    """``fp, root`` of every distinct fingerprint; ``more`` links count as well."""
    nodes = stored(fps.select("fp").distinct())
    links = near_links(nodes, radius, tile)
    groups = linked_groups(links if more is None else links.unionByName(more))
    return nodes.join(groups, nodes.fp == groups.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, radius: int = 4, words: int = 4, tile: int = TILE, least: float | None = None) -> DataFrame:
    """The documents less all but one row of each near-duplicate group, all columns as they are.

    With ``least``, texts whose sets of five-word shingles have that Jaccard similarity are linked as well.

    The row with the smallest doc_id stays (null last), of rows with one id the first of the input.
    """
    row = F.monotonically_increasing_id()
    fps = stored(fingerprints(docs.select(row.alias("row"), "doc_id", "text"), words))
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    first = fps.groupBy("fp").agg(F.min(place).alias("place"))
    more = None
    if least is not None:
        read = docs.select(row.alias("row"), "text")
        more = shingle_links(read.join(fps.select("row", "fp"), "row").select("fp", "text"), least=least)
    keep = roots(fps, radius, tile, more).join(first, "fp").groupBy("root").agg(F.min("place").alias("place"))
    named = docs.select(row.alias("row"), F.struct(*docs.columns).alias("_row"))
    return named.join(keep.select("place.row"), "row", "left_semi").select(
        *[F.col("_row")[c].alias(c) for c in docs.columns])
