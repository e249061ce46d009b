"""Document fingerprints: a homomorphic multiset hash of paragraphs."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, utf8

LANES = 128
DENSE = 8
GRAM = 8
PIECE = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(paragraph: bytes, size: int = GRAM) -> np.ndarray:
    """Hashes of all byte runs of ``size`` of a paragraph; a shorter paragraph is one run."""
    data = np.frombuffer(paragraph, np.uint8).astype(np.uint64)
    if len(data) < size:
        data = np.concatenate([data, np.full(size - len(data), 256, np.uint64)])
    h, width = data, 1
    while width < size:
        h = h[:len(h) - width] * _MIX + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def paragraph_vector(paragraph: bytes) -> np.ndarray:
    """The vector of one paragraph.

    The first ``DENSE`` lanes hold a wide hash of the whole paragraph, so equal sums mean equal multisets of
    paragraphs. The other lanes count the paragraph's byte runs, each with a sign at one hashed lane, so the angle
    between two sums follows the runs they share.
    """
    import xxhash

    out = np.zeros(DENSE + LANES, np.int64)
    for k in range(0, DENSE, 4):
        wide = xxhash.xxh3_128_intdigest(paragraph, seed=k + 1)
        out[k:k + 4] = [wide >> 32 * j & 0xFFFFFFFF for j in range(4)]
    for at in range(0, max(1, len(paragraph)), PIECE):
        h = grams(paragraph[at:at + PIECE + GRAM - 1] if at + PIECE < len(paragraph) else paragraph[at:])
        lane = (h & np.uint64(LANES - 1)).astype(np.int64)
        sign = (h >> np.uint64(40) & np.uint64(1)).astype(np.int64)
        out[DENSE:] += np.bincount(lane, minlength=LANES) - 2 * np.bincount(lane[sign == 1], minlength=LANES)
        if len(paragraph) - at <= PIECE:
            break
    return out


def paragraphs(text: bytes) -> list[bytes]:
    return [p for p in text.split(b"\n") if p]


class Fingerprint:
    """Sum of paragraph vectors: all lanes modulo 2**32. Order does not matter."""

    def __init__(self, lanes: np.ndarray | None = None):
        self.lanes = np.zeros(DENSE + LANES, np.int64) if lanes is None else lanes

    @classmethod
    def of(cls, text: bytes) -> "Fingerprint":
        made = cls()
        for p in paragraphs(text):
            made.insert(p)
        return made

    def insert(self, paragraph: bytes) -> None:
        self.add(paragraph_vector(paragraph))

    def delete(self, paragraph: bytes) -> None:
        self.add(-paragraph_vector(paragraph))

    def add(self, vector: np.ndarray) -> None:
        self.lanes = self.lanes + vector & 0xFFFFFFFF

    def edited(self, old: bytes, new: bytes) -> "Fingerprint":
        """Fingerprint of ``new`` from that of ``old``: only paragraphs that differ are taken out and put in."""
        a, b = old.split(b"\n"), new.split(b"\n")
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        made = Fingerprint(self.lanes)
        for p in filter(None, a[same:]):
            made.delete(p)
        for p in filter(None, b[same:]):
            made.insert(p)
        return made

    def text(self) -> str:
        return self.lanes.astype(">u4").tobytes().hex()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Cosine of the counting lanes as signed numbers, from 0 to 1 (no text has 2**31 runs, so none turns its sign); equal fingerprints have 1."""
    if np.array_equal(a.lanes, b.lanes):
        return 1.0
    x, y = (f.lanes[DENSE:].astype(np.uint32).view(np.int32).astype(np.float64) for f in (a, b))
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, x @ y / norm))) if norm else 0.0


def range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below the value, found in two steps so that a row compares with few of them."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    coarse = F.greatest(below(longs([g[0] for g in groups])), F.lit(1))
    return (coarse - 1) * step + below(F.element_at(F.array(*map(longs, groups)), coarse))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows ``part, doc_id, text, guest`` dealt into ranges of ``doc_id``.

    The first rows of each range also go, as guests, to the range before it, and those of the first to the last,
    so that every row finds its successor in its own range. The text is moved once. Bounds come from
    approximate quantiles of the ids; the driver sees them and one id per range.
    """
    cuts = docs.select(F.approx_percentile("doc_id", [i / ranges for i in range(1, ranges)] or [0.5],
                                           max(10_000, 8 * ranges)).alias("_cuts")).first()["_cuts"] or []
    cuts = sorted(set(cuts))
    # Ranges count from 1 upwards in doc_id; 0 holds the null ids, which come last.
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(range_of(F.col("doc_id"), cuts) + 1)
    heads = {r["part"]: r["head"] for r in docs.select(part.alias("part"), "doc_id").groupBy("part").agg(
        F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {k: order[i - 1] for i, k in enumerate(order)}  # the first range follows the last
    by_part = lambda found: F.element_at(
        F.array(*[F.lit(found.get(k)).cast("long") for k in range(len(cuts) + 2)]), F.col("part") + 1)
    own = F.struct(F.col("part").cast("long").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(by_part(before).alias("part"), F.lit(True).alias("guest"))
    copies = F.when(F.col("doc_id").eqNullSafe(by_part(heads)), F.array(own, guest)).otherwise(F.array(own))
    return docs.select(part.alias("part"), "doc_id", "text").select(
        "doc_id", "text", F.inline(copies)).select("part", "doc_id", "text", "guest")


def packed(rows: DataFrame) -> DataFrame:
    """``part, doc_id, data, guest, tie``: the texts compressed, as they cross the exchange."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text"):
            data = pa.array([pack(t) for t in utf8(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, batch.column(3), batch.column(4)],
                                             names=["part", "doc_id", "data", "guest", "tie"])

    return rows.select("part", "doc_id", "text", "guest", F.xxhash64("text").alias("tie")).mapInArrow(
        run, "part long, doc_id long, data binary, guest boolean, tie long")


def fingerprints(docs: DataFrame, ranges: int | None = None, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness to each other and the next.

    The edited text has its last third (of the code points, rounded down) replaced by as many code points from the
    start of the next document in falling ``doc_id``; after the last comes the first. Its fingerprint is made
    from the text's own by deleting and inserting the paragraphs that differ. ``ranges`` is the number of id ranges
    that the documents are dealt into; by default twice the splits of the input.

    Null texts read as empty; rows with equal ids follow each other by the text's xxhash64, null ids come last; a single
    document is its own next; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ranges = ranges or 2 * rows.rdd.getNumPartitions()
    dealt = packed(with_next(rows, ranges)).repartition(ranges, "part").sortWithinPartitions(
        F.col("part").desc(), F.col("guest"), F.col("doc_id").desc_nulls_last(), "tie").drop("tie")
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        def row(one, other):
            doc, text, fp = one
            cut = len(text) // 3
            data = text.encode()
            new = (text[:len(text) - cut] + other[1][:cut]).encode()
            changed = fp.edited(data, new)
            return (doc, len(text), hashlib.sha256(new).hexdigest(), fp.text(), changed.text(),
                    likeness(fp, changed), likeness(fp, other[2]))

        last, part, done, out = None, None, False, []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for p, doc, data, guest in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and done:
                    continue  # only the first guest of a range is anyone's successor
                data = unpack(data)
                one = (doc, data.decode(), Fingerprint.of(data))
                if p == part and last is not None:
                    out.append(row(last, one))
                if p != part:
                    part, done = p, False
                done = guest
                last = None if guest else one
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], schema=ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], schema=ARROW)

    return dealt.mapInArrow(run, schema)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                   ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                   ("near_edited", pa.float64()), ("near_next", pa.float64())])
NAMES = ARROW.names
