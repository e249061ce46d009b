"""Repeated byte strings over the whole corpus, found with suffix arrays."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.grouping import skew_join
from .common import slices, stored, utf8
from .lyndon import suffix_array

LENGTH = 400
GRAM = 256
#: A task sorts the suffixes of about so many bytes at once, and of no more segments of one key.
BATCH_BYTES = 48_000
MOST_SEGMENTS = 1_000
#: Long texts are read in pieces of so many window starts.
PIECE = 1_000_000
FILTER_WORDS = 1 << 19

_ODD = 0x9E3779B97F4A7C15
_POWERS = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS.get(1, ())) < n:
        for key, base in ((1, _ODD), (-1, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[:1] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS[1][:n], _POWERS[-1][:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on."""
    n = len(data)
    up, down = powers(n)
    marks = (np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))
    marks ^= marks >> np.uint64(29)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(marks[data] * up, dtype=np.uint64)))
    h = (sums[size:] - sums[:-size]) * down[:n - size + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value, the first of equals, in each window."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key, first, last, at``: the strings that start at ``first .. last`` share the gram at ``at``.

    The gram of a string is its smallest by hash, so equal strings have equal grams at equal places.
    """
    parts = []
    for begin in range(0, len(text) - length + 1, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - begin), begin)
        h = gram_hashes(data, gram)
        at = least_in_windows(h, length - gram + 1)
        first = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))
        last = np.concatenate((first[1:], [len(at)])) - 1
        at = at[first]
        parts.append((h[at], first + begin, last + begin, at + begin))
    if not parts:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, content, row, first, last`` of all segments.

    ``content`` is a hash of the segment's bytes and of the place of its gram.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "text"):
            out = [[] for _ in range(5)]
            for row, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
                if len(text) < length:
                    continue
                key, first, last, at = anchors(text, length, gram)
                content = [digest(text[a:b + length], seed=p - a)
                           for a, b, p in zip(first.tolist(), last.tolist(), at.tolist())]
                for k, x in enumerate((key.view(np.int64), np.array(content, np.uint64).view(np.int64),
                                       np.full(len(key), row), first, last)):
                    out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out],
                                                 names=["key", "content", "row", "first", "last"])

    return rows.select("row", "text").mapInArrow(run, "key long, content long, row long, first long, last long")


def marked(keys: DataFrame) -> np.ndarray:
    """Bit table of fixed size (4 MB) over a table of keys."""
    bit = F.expr("shiftleft(1L, int(key & 63))")
    word = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(FILTER_WORDS - 1).cast("long"))
    found = np.zeros(FILTER_WORDS, np.uint64)
    for w, bits in keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        found[w] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return found


def only_marked(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows whose key may be in the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            hit = table[(key >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)] >> (key & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(hit == 1))

    return rows.mapInArrow(run, rows.schema)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its ``length``-byte strings starts elsewhere too, in any of the texts.

    One suffix array over all texts brings equal strings together; neighbours in it are compared byte by byte.
    """
    data = np.zeros(sum(len(t) + 1 for t in texts) + 1, np.int64)
    starts, at = [], 0
    valid = np.zeros(len(data), bool)
    for t in texts:
        starts.append(at)
        data[at:at + len(t)] = np.frombuffer(t, np.uint8) + np.int64(2)
        data[at + len(t)] = 1
        valid[at:at + max(0, len(t) - length + 1)] = True
        at += len(t) + 1
    order = np.array(suffix_array(data.tolist()))
    order = order[valid[order]]
    flat = data.astype(np.int16)
    view = np.lib.stride_tricks.sliding_window_view(flat, length)
    again = np.zeros(len(data), bool)
    for k in range(0, len(order) - 1, 2048):
        a, b = order[k:k + 2048], order[k + 1:k + 2049]
        a = a[:len(b)]
        same = (view[a] == view[b]).all(1)
        again[a[same]] = True
        again[b[same]] = True
    return [again[s:s + max(0, len(t) - length + 1)] for s, t in zip(starts, texts)]


def as_ranges(flags: np.ndarray) -> np.ndarray:
    """Runs of set flags as rows [first, last]."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.stack([np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1], 1)


def sorted_groups(fetched: DataFrame, length: int) -> DataFrame:
    """``key, content, ranges``: repeated starts of each segment, as flat pairs first, last.

    ``fetched`` has ``key, content, data``, one row per distinct segment. The groups of a partition are
    sorted together, in batches of about ``BATCH_BYTES``; a group is never cut.
    """
    dealt = fetched.repartition("key").sortWithinPartitions("key", "content").select("key", "content", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def emit():
            flags = repeated_starts([x[2] for x in held], length)
            ranges = [as_ranges(f).ravel().tolist() for f in flags]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()),
                 pa.array(ranges, pa.list_(pa.int64()))], names=["key", "content", "ranges"])

        size = 0
        for batch in batches:
            for key, content, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BATCH_BYTES and key != held[-1][0]:
                    yield emit()
                    held.clear()
                    size = 0
                held.append((key, content, data))
                size += len(data)
        if held:
            yield emit()

    return dealt.mapInArrow(run, "key long, content long, ranges array<long>")


def counted_groups(fetched: DataFrame, length: int) -> DataFrame:
    """The same result for keys with very many distinct segments, by counting strings instead of sorting them.

    Each string becomes a 128-bit hash; hashes are counted before the exchange, so no task holds a key.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "data", 200_000):
            out = []
            for key, content, data in zip(*(c.to_pylist() for c in batch.columns)):
                for s in range(len(data) - length + 1):
                    out.append((key, content, s, xxhash.xxh3_128_digest(data[s:s + length])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], pa.int64()) for i in range(3)] +
                [pa.array([x[3] for x in out], pa.binary())], names=["key", "content", "start", "string"])

    strings = fetched.select("key", "content", "data").mapInArrow(
        explode, "key long, content long, start long, string binary")
    twice = strings.groupBy("key", "string").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "string")
    return (skew_join(strings, twice, ["key", "string"], "left_semi").groupBy("key", "content")
            .agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("ranges")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """``row, spans``: byte ranges [start, end) of each row covered by a string that also starts elsewhere.

    ``docs`` has ``row`` (unique) and ``text``. Only rows with some span are returned, with unmerged spans.

    Every string of ``length`` bytes is dealt by the smallest of its ``gram``-byte grams, which equal strings
    share. Neighbouring strings with the same gram form one segment of at most ``2 * length - gram`` bytes. A gram
    that occurs once holds no repeat. Segments of equal content are merged before anything is sorted, and
    their number alone makes all their strings repeats. Where a gram has several distinct segments, their bytes are
    fetched once each and sorted with a suffix array (``lyndon.suffix_array``); neighbours that agree on
    ``length`` bytes are repeats. A gram with more than ``most_segments`` distinct segments is counted by string.
    """
    found = stored(segments(docs, length, gram))
    twice = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
    shared = stored(skew_join(only_marked(found, marked(twice)), twice, ["key"], "left_semi"))
    contents = stored(shared.groupBy("key", "content").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "last")).alias("place")))
    kinds = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = stored(skew_join(contents, kinds, ["key"]).select("key", "content", "times", "kinds", "place.*"))
    wanted = mixed.groupBy("row").agg(F.collect_list(F.struct("key", "content", "first", "last", "kinds")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, parts in zip(utf8(batch, "text"), batch.column(batch.schema.get_field_index("wanted")).to_pylist()):
                out += [(p["key"], p["content"], p["kinds"], text[p["first"]:p["last"] + length]) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], pa.int64()) for i in range(3)] +
                [pa.array([x[3] for x in out], pa.binary())], names=["key", "content", "kinds", "data"])

    fetched = stored(docs.join(wanted, "row").select("text", "wanted").mapInArrow(
        fetch, "key long, content long, kinds long, data binary"))
    ranges = sorted_groups(fetched.filter(F.col("kinds") <= most_segments), length).unionByName(
        counted_groups(fetched.filter(F.col("kinds") > most_segments), length))
    # What holds for all segments of one content: repeated itself, or in part the same as another content.
    whole = contents.filter("times > 1").select(
        "key", "content", F.array(F.lit(0).cast("long"), F.col("place.last") - F.col("place.first")).alias("ranges"))
    part = ranges.join(mixed.filter("times = 1").select("key", "content"), ["key", "content"], "left_semi").filter(
        F.size("ranges") > 0)
    hits = skew_join(shared, whole.unionByName(part), ["key", "content"]).select("row", F.transform(
        F.sequence(F.lit(0), F.size("ranges") - 2, F.lit(2)), lambda i: F.struct(
            (F.col("first") + F.get("ranges", i)).alias("start"),
            (F.col("first") + F.get("ranges", i + 1) + length).alias("end"))).alias("spans"))
    return hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_segments: int = MOST_SEGMENTS,
                keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept`` (the bytes left) and ``spans``.

    Every byte is removed that a ``length``-byte string covers which starts at another place too, in the
    same document or another; strings are judged on the input, overlaps included, and never reach over the end
    of a document. Null texts read as empty; texts under ``length`` bytes are left whole; repeated rows are texts
    of their own and so repeat each other; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    joined = rows.join(repeated_spans(rows.select("row", "text"), length, gram, most_segments), "row", "left")
    joined = joined.select("doc_id", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches, "text"):
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": [], "spans": []}
            for text, spans in zip(utf8(batch, "text"), batch.column(2).to_pylist()):
                runs, left, at = merged(spans or []), [], 0
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                kept = b"".join([*left, text[at:]])
                for k, v in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept,
                                      [x for r in runs for x in r])):
                    out[k].append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.int64())]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
            names = ["doc_id", *out]
            if not keep_text:
                arrays, names = arrays[:4], names[:5]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                             + ", kept binary, spans array<long>" * keep_text)
