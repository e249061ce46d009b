"""Manifest, quality ratio and hard negatives against plain versions, on messy and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import manifest, negatives, quality_ratio
from tests.llm.test_operators import messy, none  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        out.append((run[:i % 8], run[i % 8 + 1:]))
        i //= 8
    return out


def plain_manifest(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r, leaf(*r)))
    for held in parts.values():
        held.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {p: tree([d for _, d in held]) for p, held in parts.items()}
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    top = tree([trees[p][-1][0] for p in order]) if order else None
    out = []
    for k, p in enumerate(order):
        for i, (r, d) in enumerate(parts[p]):
            proof = way(trees[p], i) + way(top, k)
            fold = d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                fold = leaf(*r[:4], r[4].translate(LOWER))
            for left, right in proof:
                fold = sha("".join(left) + fold + "".join(right))
            root = top[-1][0]
            out.append((r[0], d, trees[p][-1][0], root, sha("".join("".join(a + b) for a, b in proof)), fold, fold == root))
    return sorted(out, key=repr)


def proved(docs):
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.lower_ascii(text)).otherwise(text)
    return sorted((tuple(r) for r in manifest.verified(manifest.proofs(docs, {"text": changed})).collect()), key=repr)


def test_manifest(spark, messy, none):  # noqa: F811
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    assert proved(messy) == plain_manifest([tuple(r) for r in messy.select(*fields).collect()])
    assert proved(none) == []


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 9}, {"a": 65, None: 1, "": 8, "é": 2}, {f"p{i}": 1 for i in range(9)}])
def test_manifest_shapes(spark, sizes):
    rows = [(i * 7 % 1000, "S", part, i, f"Text {i}") for part, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert proved(docs) == plain_manifest(rows)


def test_manifest_without_tampering_verifies(messy):  # noqa: F811
    assert manifest.verified(manifest.proofs(messy)).filter("not verified").isEmpty()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_base(text):
    text = text or ""
    found = words(text)
    windows = list(zip(found, found[1:], found[2:]))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [s for s in text.split("\n") if words(s)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(found) < 50 or 100 * len(covered) > 50 * len(found))


def plain_grams(text, buckets):
    found = words(text)
    grams = found + [a[-3:] + " " + b[-3:] for a, b in zip(found, found[1:])]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_ratio(spark, messy, none):  # noqa: F811
    rows = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    labels = [(i, q) for i, q in zip(range(12), [1, 1, 0, 1, 1, 1, 0, 1, 0, 0, 0, 1])] + [(4, 0), (None, 1), (5, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_ratio.rate(messy, table, 64)
    quality = {}
    for i, q in labels:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, q))
    spared = {i for i in quality if zlib.crc32(str(i).encode()) % 4 == 3}
    raw, target = Counter(), Counter()
    for i, t in rows:
        grams = plain_grams(t, 64)
        raw.update(grams)
        if quality.get(i) == 1 and i not in spared:
            target.update(grams)
    n, m = sum(target.values()), sum(raw.values())
    weight = [round(math.log((target[b] + 4) / (raw[b] * n / m + 4)) * 1_000_000) for b in range(64)]
    def score(t):
        grams = plain_grams(t, 64)
        return sum(weight[g] for g in grams) / (len(grams) * 1_000_000) if grams else 0.0
    known = sorted((math.floor(score(t) * 1000), quality[i]) for i, t in rows
                   if i in quality and (quality[i] != 1 or i in spared) and not plain_base(t)[-1])
    bins = sorted({b for b, _ in known})
    goods, bads = sum(q == 1 for _, q in known), sum(q != 1 for _, q in known)
    merits = [(sum(q != 1 for b, q in known if b < c) * goods - sum(q == 1 for b, q in known if b < c) * bads,
               -(c + p + 1) / 2000) for p, c in zip(bins, bins[1:])]
    best = max((x for x in merits if x[0] > 0), default=None)
    want = [(i, *plain_base(t), not plain_base(t)[-1] and (best is None or score(t) >= -best[1]), score(t)) for i, t in rows]
    rated = [tuple(r) for r in got.select("doc_id", *BASE, "kept", "score").collect()]
    key = lambda r: (repr(r[:-1]), round(r[-1], 9))
    assert sorted(map(key, rated)) == sorted(map(key, want))
    assert quality_ratio.rate(none, table).count() == 0
    unlabelled = quality_ratio.rate(messy, table.limit(0))
    assert unlabelled.filter("kept = base_failed").isEmpty()


def test_quality_ratio_separates_junk(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_ratio.rate(docs, labels).join(labels, "doc_id").filter("not base_failed").select("quality", "kept").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)


def plain_negatives(rows, positives=5, negatives_=3):
    sound = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, label, [math.floor(256 * float(x)) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in sound:
        if i % 50:
            continue
        others = [(-dot(v, w), j, same == label) for j, same, w in sound if j != i]
        for p, pid, _ in sorted(o for o in others if o[2])[:positives]:
            fit = sorted(o for o in others if not o[2] and 50 * -p <= 100 * -o[0] <= 95 * -p)[:negatives_]
            out += [(i, pid, r, j, -p, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, rank int, tile string"


@pytest.mark.parametrize("tile, block", [(negatives.TILE, negatives.BLOCK), (40, 3)])
def test_hard_negatives(spark, tile, block):
    rng = random.Random(3)
    centre = [rng.gauss(0, 1) for _ in range(10)]
    def vector(k):
        base = [c + rng.gauss(0, 0.6) for c in centre] if k % 3 else list(centre)  # a third is one vector
        return [float(np.float32(x)) for x in base]
    rows = [(k, k % 2 if k % 5 else 0, vector(k)) for k in range(400)]
    rows += [(None, 1, centre), (500, None, centre), (550, 1, None), (600, 1, [None] * 10), (650, 0, [float("nan")] * 10),
             (700, 1, [float("inf")] + [0.0] * 9), (750, 1, []), (801, 0, [0.0] * 10), (850, 1, [1.0, 2.0])]
    rows = [(i, q, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, q, v in rows]
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], VECTORS)
    got = negatives.hard_negatives(table, F.col("vec_id") % 50 == 0, tile=tile, block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_empty_and_huge(spark):
    none_ = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none_, F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, 0, [1e12, 1.0]), (1, 0, [1e12, 3.0]), (2, 1, [7e11, 1.0]), (3, 1, [1.0, 1.0])]
    got = negatives.hard_negatives(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS.replace("float", "double")),
                                   F.col("vec_id") == 0)
    assert got.count() == 0 or all(r["negative_score"] == 2 ** 63 - 1 for r in got.collect())


def test_intervals_hold():
    rng = np.random.default_rng(8)
    rows, anchors = np.floor(rng.normal(0, 40, (300, 100))), np.floor(rng.normal(0, 40, (20, 100)))
    pad = lambda m: np.pad(m, ((0, 0), (0, 28)))
    low, high = negatives.Planes(pad(anchors)).bounds(slice(0, 20), *negatives.codes(pad(rows)))
    exact = anchors @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.3 * np.linalg.norm(rows, axis=1).mean() * np.linalg.norm(anchors, axis=1).mean()


def test_windows_are_hashed_by_word(spark):
    """Windows are equal if their words are; no text is joined for a window."""
    rows = spark.createDataFrame(
        [(["a b", "c", "d", "x", "a", "b c", "d"],), (["a", "b", "c", "x", "a", "b", "c", "a"],), (["a"] * 4,), (["a", "b"],)], "w array<string>")
    assert [r[0] for r in rows.select(quality_ratio.repeated_words(F.col("w"))).collect()] == [0, 6, 4, 0]
    assert "concat(" not in rows.select(quality_ratio.repeated_words(F.col("w")))._jdf.queryExecution().analyzed().toString()
