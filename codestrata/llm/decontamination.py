"""Benchmark decontamination with one FM-index per training shard."""

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD_TABLE, slices, utf8
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 32_000_000
SHARD_BYTES = 8_000_000


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Phrases:
    """The windows of a block of benchmark items, as numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[at:at + size]), set()).update(() if name is None else (number[name],))
        self.groups = []
        for size in sorted({len(w) for w in owners}):
            rows = [w for w in owners if len(w) == size]
            held = [sorted(owners[w]) for w in rows]
            self.groups.append((np.array(rows, np.int32), np.cumsum([0, *map(len, held)]),
                                np.array([i for h in held for i in h], np.int64)))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: its number of words, the hit word ranges [from, to), the items found."""
        get, counts, kept, doc_of, word_of = self.vocabulary.get, [], [], [], []
        for k, text in enumerate(texts):
            found = words(text)
            counts.append(len(found))
            if len(found) < self.shortest or not self.shortest:
                continue
            ids = np.fromiter(map(get, found, repeat(0)), np.int32, len(found))
            # A window holds known words only, so shorter runs of them can be left out.
            edge = np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0])))
            for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]):
                if b - a >= self.shortest:
                    kept += [ids[a:b], [0]]
                    doc_of.append(np.full(b - a + 1, k))
                    word_of.append(np.arange(a, b + 1))
        results: list = [(n, [], []) for n in counts]
        if not kept:
            return results
        doc_of, word_of = np.concatenate(doc_of), np.concatenate(word_of)
        index = FMIndex(np.concatenate(kept), len(self.vocabulary) + 1)
        cover = np.zeros(len(doc_of) + 1, np.int64)
        pairs = []
        for rows, ends, held in self.groups:
            low, high = index.search(rows)
            many = high - low
            which = np.repeat(np.arange(len(rows)), many)
            at = index.locate(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + rows.shape[1], -1)
            seen = np.unique(doc_of[at] * len(rows) + which)  # document and window
            doc, which = seen // len(rows), seen % len(rows)
            owned = ends[which + 1] - ends[which]
            flat = np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned) + np.repeat(ends[which], owned)
            pairs.append(np.repeat(doc, owned) * max(1, len(self.names)) + held[flat])
        for pair in np.unique(np.concatenate(pairs)).tolist():
            results[pair // len(self.names)][2].append(self.names[pair % len(self.names)])
        edge = np.diff(np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).view(np.int8), [0])))
        for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]):
            results[doc_of[a]][1].append((int(word_of[a]), int(word_of[a] + b - a)))
        return results


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str, most: int) -> Iterator[list]:
    """The benchmark in blocks of about ``most`` bytes; the driver holds one block at a time."""
    block, size = [], 0
    for name, text in benchmark.select(F.col(id_column).cast("string"), F.col(text_column)).toLocalIterator():
        data = (text or "").encode()
        block.append((name, data))
        size += len(data)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id",
         text_column: str = "text", item_column: str = "item_id", item_text: str = "text", carry=(),
         block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, ranges, items`` (the columns named in ``carry``, the text if asked) of every document.

    ``ranges`` are the maximal runs [start, end) of words inside an occurrence of a benchmark window of
    ``window`` words (an item of fewer words is one window), ``items`` the sorted ids, as text, of the items
    that own a window found. Each task cuts its documents into shards, builds an FM-index over the
    shard's runs of benchmark words, and searches all windows at once from their last word to their first.

    The benchmark is a stated query set. It is read in blocks of bounded size; each block adds one pass
    over the documents inside the same tasks, without an exchange. Null texts have no words; an item
    without words finds nothing; an item without an id marks words but is not listed; repeated rows are
    kept; an empty table on either side gives no hits.
    """
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *carry,
                       F.lit(0).cast("long").alias("n_words"),
                       F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("ranges"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    schema = rows.schema
    blocks = item_blocks(benchmark, item_column, item_text, block_bytes)
    # Without any item one pass counts the words.
    for block in chain([next(blocks, [])], blocks):
        phrases = Phrases(block, window)

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SHARD_BYTES):
                names = batch.schema.names
                found = phrases.scan(utf8(batch, "text"))
                old_ranges = batch.column(names.index("ranges")).to_pylist()
                old_items = batch.column(names.index("items")).to_pylist()
                ranges = [merged([(r["start"], r["end"]) for r in o] + f[1]) for o, f in zip(old_ranges, found)]
                new = {"n_words": pa.array([f[0] for f in found], pa.int64()),
                       "ranges": pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], RANGES),
                       "items": pa.array([sorted({*o, *f[2]}) for o, f in zip(old_items, found)],
                                         pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

        rows = rows.mapInArrow(run, schema)
    return rows.select("doc_id", *carry, *["text"] * with_text, "n_words", "ranges", "items")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and item digest per document."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return scanned.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                          (hit > 0).alias("contaminated"))


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the hit words cut out; every row stays, clean texts unchanged.

    A removal span runs from the first byte of the first hit word to the last byte of the last one; a
    line break takes its place.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("_row"))
    scanned = scan(row, benchmark, window, carry=("_row",), with_text=True).select("doc_id", "_row", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t if not r else without_words(t.encode(), [(x["start"], x["end"]) for x in r]).decode()
                     for t, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), batch.column(3)],
                                             names=batch.schema.names)

    done = scanned.mapInArrow(run, scanned.schema)
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in docs.columns])


def without_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text less the given runs of words."""
    flat = np.frombuffer(text.translate(WORD_TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    out, at = [], 0
    for a, b in ranges:
        out += [text[at:starts[a]], b"\n"]
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])
