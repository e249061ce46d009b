"""Hard-negative mining: rotated one-bit codes, interval filter, integer scores."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import stored

SEED = 11
#: One-bit codes per vector, each of what the codes before it leave.
STAGES = 6
#: Bits to which an anchor's coordinates are rounded.
PLANES = 8
TILE, BLOCK = 8_192, 2_048
#: Widens intervals by this share of the product of both lengths, for the rounding of the floating-point estimates.
SLACK = 1e-9
CELLS = 1 << 19


@lru_cache(2)
def rotation(width: int) -> np.ndarray:
    """A fixed random rotation of ``width`` coordinates, a multiple of 64."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def wide(size: int) -> int:
    return max(64, -(-size // 64) * 64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows, filled with zeros up to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def codes(vectors: np.ndarray, stages: int = STAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits, alignment with each code vector, length of what is left, length of the vector.

    A code vector has all coordinates at plus or minus 1 / sqrt(width). Its alignment is its inner product with what
    the codes before it left, and what it leaves is orthogonal to it.
    """
    width = vectors.shape[1]
    left = vectors @ rotation(width).T
    length = np.linalg.norm(left, axis=1)
    bits = np.empty((len(left), stages, width // 64), np.uint64)
    align = np.empty((len(left), stages))
    for s in range(stages):
        up = left >= 0
        bits[:, s] = np.packbits(up, axis=1, bitorder="little").view(np.uint64)
        align[:, s] = np.abs(left).sum(1) / np.sqrt(width)
        left -= np.where(up, 1.0, -1.0) * (align[:, s, None] / np.sqrt(width))
    return bits, align, np.linalg.norm(left, axis=1), length


class Planes:
    """Anchors as bit planes of their rotated, rounded coordinates."""

    def __init__(self, vectors: np.ndarray):
        turned = vectors @ rotation(vectors.shape[1]).T
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2 ** PLANES - 1), np.finfo(float).tiny)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = whole.sum(1, dtype=np.int64)
        self.error = np.linalg.norm(turned - (self.low[:, None] + self.step[:, None] * whole), axis=1)
        self.length = np.linalg.norm(turned, axis=1)
        self.bits = [np.packbits((whole >> b) & 1, axis=1, bitorder="little").view(np.uint64) for b in range(PLANES)]

    def bounds(self, at: slice, bits: np.ndarray, align: np.ndarray, rest: np.ndarray,
               length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of some anchors with all rows.

        Population counts give the product of the rounded anchor with each code vector. What the codes leave is
        orthogonal to the last code vector, so Cauchy-Schwarz bounds its part by the two lengths beside that vector;
        the rounding of the anchor is bounded by its error and the row's length.
        """
        width = bits.shape[2] * 64
        n = len(self.low[at])
        estimate = np.zeros((n, len(bits)))
        last = estimate
        for s in range(bits.shape[1]):
            sums = np.zeros((n, len(bits)), np.int64)
            for b, plane in enumerate(self.bits):
                for w in range(bits.shape[2]):
                    sums += np.bitwise_count(plane[at, None, w] & bits[None, :, s, w]).astype(np.int64) << b
            ones = np.bitwise_count(bits[:, s]).sum(1, dtype=np.int64)
            last = (self.low[at, None] * (2 * ones - width)[None, :]
                    + self.step[at, None] * (2 * sums - self.total[at, None])) / np.sqrt(width)
            estimate += align[None, :, s] * last
        beside = np.maximum(np.abs(last) - self.error[at, None], 0)
        half = rest * np.sqrt(np.maximum(self.length[at, None] ** 2 - beside ** 2, 0))
        half += self.error[at, None] * (length + rest) + SLACK * self.length[at, None] * length + 1e-6
        low, high = estimate - half, estimate + half
        return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs of rows (i, j); beyond a long they stand at its ends."""
    if not len(i):
        return np.zeros(0, np.int64)
    top = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if top < 2.0 ** 62:
        out = np.empty(len(i), np.int64)
        whole_a, whole_b = a.astype(np.int64), b.astype(np.int64)
        for at in range(0, len(i), 1 << 16):
            out[at:at + (1 << 16)] = np.einsum("ij,ij->i", whole_a[i[at:at + (1 << 16)]], whole_b[j[at:at + (1 << 16)]])
        return out
    exact = [sum(int(x) * int(y) for x, y in zip(a[p], b[q])) for p, q in zip(i, j)]
    return np.array([min(max(x, -2 ** 63), 2 ** 63 - 1) for x in exact], np.int64)


def first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, groups))  # ~ turns the order without overflow
    g = groups[order]
    start = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0)) if len(g) else g
    return order[rank < k]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def read(table: pa.Table, width: int) -> dict[str, np.ndarray]:
    table = table.combine_chunks()
    column = lambda name: table.column(name).combine_chunks() if table.num_rows else None
    if not table.num_rows:
        return {}
    out = {"ids": column("vec_id").to_numpy(), "labels": column("label").to_numpy(), "whole": matrix(column("whole"), width)}
    if "bits" in table.column_names:
        n = table.num_rows
        out["bits"] = column("bits").flatten().to_numpy().view(np.uint64).reshape(n, -1, width // 64)
        out["align"] = column("align").flatten().to_numpy().reshape(n, -1)
        out["rest"], out["length"] = column("rest").to_numpy(), column("length").to_numpy()
    return out


def positives_of(anchors: dict, rows: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block and a tile: anchor place, id and score of the first ``k`` other rows of each anchor's label."""
    out: list[tuple] = []
    for label in np.unique(anchors["labels"]):
        mine, same = np.nonzero(anchors["labels"] == label)[0], np.nonzero(rows["labels"] == label)[0]
        planes = Planes(anchors["whole"][mine])
        coded = [rows[c][same] for c in ("bits", "align", "rest", "length")]
        step = max(1, CELLS // max(1, len(same)))
        for at in range(0, len(mine) if len(same) else 0, step):
            part = slice(at, at + step)
            low, high = planes.bounds(part, *coded)
            itself = anchors["ids"][mine[part], None] == rows["ids"][None, same]
            low[itself] = -np.inf
            i, j = np.nonzero((high >= kth(low, k)[:, None]) & ~itself)
            i, j = mine[part][i], same[j]
            score = products(anchors["whole"], rows["whole"], i, j)
            keep = first(i, score, rows["ids"][j], k)
            out.append((i[keep], rows["ids"][j[keep]], score[keep]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((),) * 3))


def negatives_of(anchors: dict, windows: tuple[np.ndarray, np.ndarray], rows: dict, k: int) -> tuple:
    """Of a block and a tile: anchor place, positive's number, id and score of the first ``k`` other-label rows in each window.

    ``windows`` hold the lowest and highest score for each anchor (row) and positive (column); a window that is
    empty by its bounds finds nothing.
    """
    out: list[tuple] = []
    floor, ceiling = windows
    for label in np.unique(anchors["labels"]):
        mine, other = np.nonzero(anchors["labels"] == label)[0], np.nonzero(rows["labels"] != label)[0]
        planes = Planes(anchors["whole"][mine])
        coded = [rows[c][other] for c in ("bits", "align", "rest", "length")]
        step = max(1, CELLS // max(1, len(other)))
        for at in range(0, len(mine) if len(other) else 0, step):
            part = slice(at, at + step)
            low, high = planes.bounds(part, *coded)
            near = np.zeros(low.shape, bool)
            for n in range(floor.shape[1]):
                a, b = (w[mine[part], n, None].astype(np.float64) for w in windows)
                sure = kth(np.where((low >= a) & (high <= b), low, -np.inf), k)
                near |= (high >= np.maximum(a, sure[:, None])) & (low <= b) & (a <= b)
            i, j = np.nonzero(near)
            i, j = mine[part][i], other[j]
            score = products(anchors["whole"], rows["whole"], i, j)
            for n in range(floor.shape[1]):
                inside = np.nonzero((score >= floor[i, n]) & (score <= ceiling[i, n]))[0]
                keep = inside[first(i[inside], score[inside], rows["ids"][j[inside]], k)]
                out.append((i[keep], np.full(len(keep), n), rows["ids"][j[keep]], score[keep]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((),) * 4))


def coded_rows(rows: DataFrame, width: int, stages: int = STAGES) -> DataFrame:
    """``rows`` with ``bits, align, rest, length``: the codes of ``whole`` and their alignments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("whole")
            bits, align, rest, length = codes(matrix(batch.column(at), width), stages)
            listed = lambda m, kind: pa.ListArray.from_arrays(
                pa.array(np.arange(len(m) + 1, dtype=np.int32) * m[:1].size if len(m) else [0], pa.int32()),
                pa.array(np.ascontiguousarray(m).reshape(-1), kind))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, listed(bits.view(np.int64), pa.int64()), listed(align, pa.float64()), pa.array(rest),
                 pa.array(length)], names=[*batch.schema.names, "bits", "align", "rest", "length"])

    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    schema = rows.select("*", empty("bigint").alias("bits"), empty("double").alias("align"), F.lit(0.0).alias("rest"),
                         F.lit(0.0).alias("length")).schema
    return rows.mapInArrow(run, schema)


def usable(rows: DataFrame, id_column: str, label: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, label, whole`` of the rows that take part; ``whole`` holds floor(scale * x)."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    picked = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Whole numbers stay doubles here: F.floor would make them longs and overflow.
    whole = F.transform("x", lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0))
    return picked.filter("vec_id is not null and label is not null and x is not null").filter(sound).select(
        "vec_id", "label", whole.alias("whole"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50,
                   most: int = 95, scale: int = 256, id_column: str = "vec_id", label: str = "label",
                   vector: str = "embedding", tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of the vectors' components floor(``scale`` * x); higher scores come first, ties by smaller id. For
    each row that meets ``anchors`` (a condition on ``vec_id`` and ``label``) and each of its first ``positives``
    other rows of its label, the first ``negatives`` rows of another label whose score is at least ``least`` and at most
    ``most`` hundredths of the positive's.

    Every row is stored with rotated one-bit codes and its alignment with their code vectors. All anchors meet all rows
    in blocks and tiles of bounded size, one group of work for each pair of them, so no label and no vector
    gathers in one task. In a group, population counts and the Cauchy-Schwarz bound of the rest give each score an
    interval; only rows whose interval can reach the result are scored, in integers, so the result is exact.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors are
    filled with zeros; rows that share an anchor's id are not its others; repeated rows take part each, repeated anchors answer each; scores beyond a
    long stand at its ends; an empty table gives no rows; other columns are ignored.
    """
    base = stored(usable(rows, id_column, label, vector, scale))
    n, size = base.agg(F.count(F.lit(1)), F.max(F.size("whole"))).first()
    width = wide(size or 0)
    tiles = max(1, -(-n // tile))
    coded = stored(coded_rows(base.withColumn("tile", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tiles)).cast("int")),
                              width))
    picked = stored(coded.filter(anchors).select("vec_id", "label", "whole", F.monotonically_increasing_id().alias("anchor")))
    blocks = max(1, -(-picked.count() // block))
    pairs = tiles * blocks
    numbered = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    right = (coded.withColumn("block", numbered(blocks)).repartition(pairs, "tile", "block").groupBy("tile", "block"))

    def left(df: DataFrame):
        rows = df.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).withColumn("tile", numbered(tiles))
        return rows.repartition(pairs, "tile", "block").groupBy("tile", "block")

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        found: tuple = ((), (), ())
        if a.num_rows and b.num_rows:
            i, ids, score = positives_of(read(a, width), read(b, width), positives)
            found = (a.column("anchor").to_numpy()[i], ids, score)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["anchor", "positive_id", "positive_score"])

    ranked = lambda df, key, score, other: df.withColumn("rank", F.row_number().over(
        W.partitionBy(*key).orderBy(F.col(score).desc(), other)))
    best = ranked(left(picked).cogroup(right).applyInArrow(near, "anchor long, positive_id long, positive_score long"),
                  ["anchor"], "positive_score", "positive_id").filter(F.col("rank") <= positives)
    listed = stored(picked.join(best.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("rank", "positive_id", "positive_score"))).alias("found")), "anchor")
        .withColumn("scores", F.transform("found", lambda p: p["positive_score"])))

    def hard(a: pa.Table, b: pa.Table) -> pa.Table:
        found: tuple = ((), (), (), ())
        if a.num_rows and b.num_rows:
            scores = a.column("scores").to_pylist()
            floor, ceiling = np.zeros((len(scores), positives), np.int64), np.full((len(scores), positives), -1, np.int64)
            for r, row in enumerate(scores):
                for c, p in enumerate(row):
                    lowest, highest = -(-least * p // 100), most * p // 100
                    if lowest <= highest:
                        floor[r, c], ceiling[r, c] = lowest, highest
            i, number, ids, score = negatives_of(read(a, width), (floor, ceiling), read(b, width), negatives)
            found = (a.column("anchor").to_numpy()[i], number, ids, score)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["anchor", "number", "negative_id", "negative_score"])

    kept = ranked(left(listed.drop("found")).cogroup(right).applyInArrow(
        hard, "anchor long, number long, negative_id long, negative_score long"),
        ["anchor", "number"], "negative_score", "negative_id").filter(F.col("rank") <= negatives)
    named = listed.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("number", "found"))
    return kept.join(named.withColumn("number", F.col("number").cast("long")), ["anchor", "number"]).select(
        "anchor_id", F.col("found")["positive_id"].alias("positive_id"), "rank", "negative_id",
        F.col("found")["positive_score"].alias("positive_score"), "negative_score")
