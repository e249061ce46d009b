"""The text operators on messy rows and empty tables, each against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from codestrata.llm import (chat, decontamination, edits, fingerprint, licenses, lines, lyndon, mixing, repeats, simhash,
                            tokens, toxicity)
from codestrata.llm.common import least_labels, linked_groups, stored

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, fp string, score string, "
          "language string, n_lines string, spans string, copies string, size string, node string")


def words_of(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def messy_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(5)
    base = words_of(rng, 120)
    passage = words_of(rng, 90)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), base + "\n" + passage, words_of(rng, 40) + "\n" + passage + "\n" + words_of(rng, 9),
             None, "", " \t\n", "one", "x" * 1500, "ab" * 700, words_of(rng, 30_000), "é😀 " * 300 + passage, "a b c\na b c\na b d",
             "This is under the MIT License.\nLicensed under the Apache License, Version 2.0 (the License); you may not use "
             "this file except in compliance with the License.", "GNU General Public License general public license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other text of the same id"), (None, base), (None, None)]
    clash = ("r", "f", "s", "l", "n", "p", "c", "z", "o")
    return [(i, t, None if k % 4 == 0 else "en", [None, "s", "t"][k % 3], None, *clash) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    spark.createDataFrame(messy_rows(), SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts():
    return [(r[0], r[1] or "") for r in messy_rows()]


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))] + [0]
        assert lyndon.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_linked_groups(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 470)]
    pairs += [(1000, i) for i in range(1001, 1100)]
    got = dict(collected(linked_groups(spark.createDataFrame(pairs, "a long, b long")), "node", "root"))
    u, v = np.array(pairs).T
    label = least_labels(u, v, 1200)
    assert got == {n: int(label[n]) for a, b in pairs for n in (a, b) if a != b}
    assert linked_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats(messy, none):
    for length, gram, most in ((60, 40, 1000), (60, 40, 1)):
        rows = texts()
        seen = Counter()
        for _, t in rows:
            b = t.encode()
            seen.update(b[s:s + length] for s in range(len(b) - length + 1))
        want = []
        for i, t in rows:
            b = t.encode()
            cover = np.zeros(len(b) + 1, int)
            for s in range(len(b) - length + 1):
                if seen[b[s:s + length]] > 1:
                    cover[s:s + length] = 1
            keep = bytes(x for x, c in zip(b, cover) if not c)
            runs = int((np.diff(np.concatenate(([0], cover))) == 1).sum())
            want.append((i, len(b), int(cover.sum()), runs, hashlib.sha256(keep).hexdigest()))
        got = repeats.cut_repeats(messy, length, gram, most)
        assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert repeats.cut_repeats(none).count() == 0


def test_line_dedup(messy, none):
    got = lines.dedup_lines(messy)
    hasher, seen, want, known = lines.Hasher(), [], [], {}
    order = sorted(range(len(texts())), key=lambda k: (texts()[k][0] is None, texts()[k][0] or 0, k))
    rows = texts()
    distinct, places = [], []
    for k in order:
        for n, line in enumerate(rows[k][1].split("\n")):
            w = lines.normal(line.encode())
            if len(w) >= lines.MIN_WORDS:
                c = b" ".join(w).decode("utf-8", "replace")
                if c not in known:
                    known[c] = len(distinct)
                    distinct.append(c)
                places.append((k, n, known[c]))
    fp = hasher.lines([d.encode().split(b" ") for d in distinct])[1].view(np.uint64)
    u, v = zip(*[(a, b) for a in range(len(distinct)) for b in range(a)
                 if int(fp[a] ^ fp[b]).bit_count() <= 3 and lines.similar(distinct[a], distinct[b])] or [(0, 0)])
    group, gone = least_labels(np.array(u), np.array(v), len(distinct)), set()
    for k, n, d in places:
        if group[d] in seen:
            gone.add((k, n))
        seen.append(group[d])
    for k, (i, t) in enumerate(messy_rows()[j][:2] for j in range(len(rows))):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)
        want.append((i, kept))
    assert collected(got, "doc_id", "text") == sorted(want, key=repr)
    assert any(t for t in gone)
    assert lines.dedup_lines(messy, counts=False).columns == messy.columns
    assert lines.dedup_lines(none).count() == 0


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    rng = random.Random(3)
    for _ in range(800):
        a, b = ("".join(rng.choices("ab c", k=rng.randint(0, 14))) for _ in range(2))
        assert lines.edit_distance(a, b) == slow(a, b) <= lines.edits_at_most(a.split(" "), b.split(" "))
    for _ in range(200):  # many pairs in one number, with lanes of several bytes and empty texts
        a = "".join(rng.choices("ab \u00fc", k=rng.choice([0, 1, 7, 8, 9, 64, 70])))
        others = ["".join(rng.choices("ab \u00fc", k=rng.choice([0, 1, 8, 63, 90]))) for _ in range(rng.randint(1, 6))]
        others.append("".join(c for c in a if rng.random() < 0.9))
        most = [rng.choice([0, 1.5, 8, 40, 64.1]) for _ in others]
        exact = [slow(a, b) for b in others]
        assert lines.within(a, others, most) == [d <= m for d, m in zip(exact, most)]
        for b, d, m in zip(others, exact, most):
            assert (lines.edit_distance(a, b, m) <= m) == (d <= m)


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    parts = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(messy, none):
    rows = [(i, slow_fingerprint(t)) for i, t in texts()]
    u, v = zip(*[(a, b) for a in range(len(rows)) for b in range(a + 1) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4])
    label = least_labels(np.array(u), np.array(v), len(rows))
    least = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None)
             for g in set(label.tolist())}
    want = sorted(((i, f, least[int(label[k])]) for k, (i, f) in enumerate(rows)), key=repr)
    for tile in (16_384, 2):
        got = simhash.near_duplicates(messy, tile=tile)
        assert sorted(((a, b & (1 << 64) - 1, c) for a, b, c in collected(got, "doc_id", "fp", "component_id")), key=repr) == want
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and kept.count() == len(set(label.tolist()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_tiles_return_a_star_per_group():
    a = np.array([0, 1, 3, 7, 15, -1], np.int64)
    u, v = simhash.tile_links(a, None, 1)
    assert sorted(zip(u.tolist(), v.tolist())) == [(1, 0), (3, 0), (7, 0), (15, 0)]
    u, v = simhash.tile_links(a[:2], a[2:], 4)
    assert set(u.tolist()) | set(v.tolist()) == {0, 1, 3, 7, 15}


ITEMS = "item_id long, text string, n_words string"


def test_decontamination(spark, messy, none):
    passage = texts()[4][1].split("\n")[1].split()
    items = spark.createDataFrame([(7, " ".join(passage[:30]), "x"), (12, " ".join(passage[25:60]).upper(), "x"), (7, "a b c", "x"),
                                   (3, "one", "x"), (4, None, "x"), (5, "", "x"), (None, "ab cd", "x")], ITEMS)
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {}
    for i, t, _ in items.collect():
        w = find(t or "")
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(i)
    want = []
    for i, t in texts():
        w, hit, found = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k:k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in own if x is not None}
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for size in (1 << 20, 40):
        got = decontamination.digest(decontamination.scan(messy, items, block_bytes=size))
        assert collected(got, *columns) == sorted(want, key=repr)
    cut = decontamination.cut(messy, items)
    assert cut.columns == messy.columns and cut.count() == messy.count()
    again = decontamination.digest(decontamination.scan(cut, items))
    assert again.filter("contaminated").isEmpty()
    clean = {i for i, *_, c in want if not c}
    before, after = (dict(collected(d, "doc_id", "text")) for d in (messy, cut))
    assert all(before[i] == after[i] for i in clean if i not in (3, None))
    assert decontamination.digest(decontamination.scan(messy, items.limit(0))).filter("contaminated").isEmpty()
    assert decontamination.scan(none, items).count() == 0


def test_fingerprints(messy, none):
    tie = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).astype(np.int64)
    rows = sorted(texts(), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    want = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        new = t[:len(t) - cut] + n[:cut]
        a, b, c = (fingerprint.Fingerprint.of(x.encode()) for x in (t, new, n))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a.text(), b.text(), round(fingerprint.likeness(a, b), 9),
                     round(fingerprint.likeness(a, c), 9)))
    for ranges in (1, 3, 9):
        got = fingerprint.fingerprints(messy, ranges)
        found = collected(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                          F.round("near_edited", 9), F.round("near_next", 9))
        assert found == sorted(want, key=repr)
    assert fingerprint.fingerprints(none).count() == 0
    assert fingerprint.fingerprints(messy.filter("doc_id = 8")).select("near_next").collect()[0][0] == 1.0


def test_multiset_hash_ignores_order_and_takes_edits():
    a = fingerprint.Fingerprint.of(b"one\ntwo\nthree\nthree")
    assert a.text() == fingerprint.Fingerprint.of(b"three\none\nthree\ntwo").text()
    assert a.text() != fingerprint.Fingerprint.of(b"three\none\ntwo").text()
    a.delete(b"three")
    a.insert(b"four")
    assert a.text() == fingerprint.Fingerprint.of(b"four\nthree\ntwo\none").text()


def test_licenses(spark, messy, none):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    want = []
    for i, t in texts():
        w, at, labels = find(t), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            own = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = licenses.scan(messy)
    assert collected(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert got.filter("NOT score BETWEEN 0 AND 1").isEmpty() and licenses.scan(none).count() == 0
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    kelvin = "mit licen" + chr(0x17F) + "e"
    rows = spark.createDataFrame([(1, bsd), (2, "redistribution of licensed forms"), (3, kelvin)], "doc_id long, text string")
    assert collected(licenses.scan(rows), "doc_id", "labels", "base_labels") == [(1, "bsd", ""), (2, "", ""), (3, "", "")]


def test_mixing(spark, messy, none):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.lit("x").alias("_size"))
    got = mixing.mix(rows).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["source_size"] and 0 <= r["copies"] <= 2
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in full or open_:
            want[s] = 2.0 * size[s] if full else level * weight[s]
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    assert all(abs(taken[s] - want[s]) <= 16 for s in order)
    assert mixing.mix(messy).count() == messy.count()
    kept = mixing.take(messy)
    assert set(kept.columns) == set(messy.columns) and kept.filter("copies < 1").isEmpty()
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0


def test_token_counts(messy, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path)
    rows = sorted(((i, len(t.encode()), len(want.encode(t, add_special_tokens=False))) for i, t in texts()), key=repr)
    assert collected(tokens.count_tokens(messy, path), "doc_id", "n_bytes", "n_tokens") == rows
    counter, rng = tokens.Counter(path, keep=50), random.Random(2)
    letters = list("aé漢😀 \t\n\x1c\x85 12'strell<>") + ["<|endoftext|>", "'re", "  "]
    for _ in range(3000):
        t = "".join(rng.choices(letters, k=rng.randint(0, 20)))
        assert counter.text(t) == len(want.encode(t, add_special_tokens=False))
    assert tokens.count_tokens(none, path).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    tricky = ["### assistant: x", "</turn>\n### user: y", "\\", "a\\", "\\### Assistant: </turn> ok", "#", "####", "<\\/turn>", "",
              "<", "</turn", "x" * 5000, "😀é\n"]
    rows = [(k % 3, k, r, t, "c") for k, (t, r) in enumerate((t, r) for t in tricky for r in ("user", "assistant", "odd: \n~ #"))]
    rows += [(9, None, None, None, "c"), (9, 0, "assistant", None, "c"), (9, 0, "assistant", "b", "c"), (9, 0, "assistant", "b", "c"),
             (None, 1, "user", "u", None)]
    made = chat.format_chats(spark.createDataFrame(rows, schema))
    read = chat.read_back(made)
    want = []
    for c in {r[0] for r in rows}:
        turns = sorted(((t is None, t or 0, r or "", x or "") for i, t, r, x, _ in rows if i == c))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        want.append((c, len(turns), "".join(f"{r}\n{x}\n" for *_, r, x in turns), loss))
    assert collected(read, "conv_id", "n_turns", "turns_text", "loss_text") == sorted(want, key=repr)
    assert read.join(made.select("conv_id", "source_turns"), "conv_id").filter("n_turns <> source_turns").isEmpty()
    for r in read.collect():  # the mask lies on bodies only
        assert sum(m["n_chars"] for m in r["mask"]) < r["formatted_chars"]
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], schema))).count() == 0


def test_toxicity(spark, messy, none):
    rng, rows, marks = random.Random(6), [], []
    for i in range(1500):
        bad = rng.random() < 0.2
        w = words_of(rng, rng.randint(5, 40)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "nastyish"]))
        rows.append((i, " ".join(w), "z"))
        marks.append((i, int(bad), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks + [(None, 1, 1), (5000, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    truth = dict(m[:2] for m in marks)
    held = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).filter(toxicity.remainder() == 0).collect()}
    right = sum((s >= 0.5) == bool(truth[i]) for i, s in held.items())
    assert len(held) > 200 and right / len(held) > 0.97
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 1100 < kept.count() < 1300
    found = toxicity.score(messy, model)
    assert found.count() == messy.count() and found.filter("NOT score BETWEEN 0 AND 1").isEmpty()
    assert toxicity.keep_clean(messy, model).columns == messy.columns
    assert toxicity.score(none, model).count() == 0
    # Nothing to learn from: one score for all, and nothing is thrown away unless all labels are toxic.
    for marked, least, most in ((labels.limit(0), 0.2, 0.3), (labels.filter("toxic = 0"), 0.2, 0.3), (labels.filter("toxic = 1"), 0.7, 0.8)):
        lame = toxicity.train(docs, marked)
        found = {r["score"] for r in toxicity.score(messy, lame).collect()}
        assert len(found) == 1 and least < found.pop() < most
    # The sample, and so the model, does not follow the layout of the tables, repeated ids included.
    twice = docs.unionByName(docs.filter("doc_id < 300").withColumn("text", F.concat("text", F.lit(" again"))))
    one, two = (toxicity.train(d, labels, all_bytes=20_000) for d in (twice.repartition(7, "text"), twice.orderBy(F.desc("doc_id"))))
    assert np.array_equal(one.slots, two.slots) and np.array_equal(one.head, two.head) and one.thresholds == two.thresholds


def plain_logit(model, text):
    """The forward pass in loops: embedding of each word, each window of each filter, maximum, head."""
    words = toxicity.text_words(text)
    vectors = [sum(model.slots[s].astype(float) for s in toxicity.word_slots(w)) for w in words]
    pooled = []
    for width, bank in zip(toxicity.WIDTHS, model.filters):
        for f in range(bank.shape[2]):
            found = [sum(float(vectors[i + j] @ bank[j][:, f]) for j in range(width) if i + j < len(words)) for i in range(len(words))]
            pooled.append(max(found, default=0.0))
    return sum(max(p + float(b), 0.0) * float(h) for p, b, h in zip(pooled, model.bias, model.head)) + model.base


def test_toxicity_forward_pass(monkeypatch):
    """Scores against plain loops: no text's score depends on the texts beside it or on where chunks end."""
    rng = random.Random(4)
    texts = [words_of(rng, n).encode() for n in (1, 2, 3, 40, 7, 1)] + [b"", "\u00c4h \u4e2d\u6587 the the".encode(), b"", b"12 ."]
    rng.shuffle(texts)
    model = toxicity.Model.fresh(3)
    model.bias += np.linspace(-0.2, 0.2, len(model.bias), dtype=np.float32)
    expected = [plain_logit(model, t) for t in texts]
    for chunk in (toxicity.CHUNK, 5, 1):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        got, _ = toxicity.Scorer(model).logits([toxicity.text_words(t) for t in texts])
        assert np.allclose(got, expected, atol=1e-4)


def test_scores_read_long_texts_whole():
    rng = random.Random(8)
    model = toxicity.Model.fresh()
    words = [w.encode() for w in words_of(rng, 150_000).split()]
    scorer, other = toxicity.Scorer(model), toxicity.Scorer(model)
    whole, _ = scorer.read([words, words[:10], [], words[-7:]])
    parts = np.max([other.read([words[a:a + 1002]])[0][0] for a in range(0, len(words), 1000)], 0)
    # Chunks that overlap by two words see all windows; their own ends only add shorter ones.
    assert (whole[0] <= parts + 1e-5).all() and np.isfinite(whole).all()
    assert (np.abs(whole[0] - parts) < 1e-5).mean() > 0.9


def similar_lines(rng, n):
    """Lines of 2 to 60 words, each with a copy in which about a tenth of the words changed."""
    out = []
    for _ in range(n):
        w = words_of(rng, rng.choice([2, 4, 8, 15, 30, 60])).split()
        copy = list(w)
        for k in rng.sample(range(len(w)), max(1, len(w) // 10)):
            copy[k] = copy[k][:-1] + rng.choice("klmnop")
        out += [" ".join(w), " ".join(copy)]
    return out


def test_similar_lines_meet_whatever_their_bits(spark):
    made = similar_lines(random.Random(12), 150)
    found = [m.encode() for m in made]
    pairs = [(a, b) for a in range(len(made)) for b in range(a) if lines.similar(made[a], made[b])]
    fp = lines.Hasher().lines([f.split(b" ") for f in found])[1].view(np.uint64)
    assert sum(int(fp[a] ^ fp[b]).bit_count() <= 3 for a, b in pairs) < 0.5 * len(pairs)
    rng = random.Random(13)
    rng.shuffle(made)
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = lines.dedup_lines(stored(rows), radius=None, min_words=1).filter("text <> ''").count()
    label = least_labels(*map(np.array, zip(*pairs)), len(made))
    whole = len(set(label.tolist()))
    assert whole <= kept <= whole + 0.05 * len(pairs)


def test_clusters_in_tiles_link_the_same_lines(spark, monkeypatch):
    rng = random.Random(21)
    base = words_of(rng, 40).split()
    made = [" ".join(base[:k] + ["zz"] + base[k + 1:]) for k in range(30)] + similar_lines(rng, 10)
    docs = stored(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    members = spark.createDataFrame([(1, n, 5) for n in range(30)] + [(2, 3, 5), (2, 4, 6)], "cluster long, line long, fp long")
    got = {}
    for size in (1_000, 4):
        monkeypatch.setattr(lines, "TILE", size)
        got[size] = collected(lines.dedup_lines(docs, radius=None), "doc_id", "text", "n_removed")
    assert got[1_000] == got[4] and sum(r[2] for r in got[4]) >= 29
    held = {}
    for r in lines.tiles(members).collect():
        held.setdefault(r["cluster"], []).append((r["line"], r["side"]))
    assert all(len({side for _, side in rows}) <= 2 for rows in held.values())
    together = {(a, b) for rows in held.values() for a, x in rows for b, y in rows
                if a < b and (x != y or len({side for _, side in rows}) == 1)}
    assert together == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_a_node_with_many_edges_is_one_group(spark):
    edges = spark.range(1, 3_000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    found = linked_groups(edges.unionByName(spark.createDataFrame([(9_001, 9_000)], "a long, b long")))
    assert found.filter("root = 0").count() == 3_000 and found.filter("root = 9000").count() == 2


def test_lines_of_one_or_two_words_take_part(spark):
    rows = spark.createDataFrame([(1, "les\n\u4f60\u597d\u4e16\u754c\u518d\u89c1\n--"), (2, "Les!\nerheed titionly\n--"),
                                  (3, "\u4f60\u597d\u4e16\u754c\u518d\u89c1\nerheed  titionly")], "doc_id long, text string")
    for radius in (lines.RADIUS, None):
        got = lines.dedup_lines(stored(rows), radius=radius)
        assert collected(got, "doc_id", "text", "n_removed") == [
            (1, "les\n\u4f60\u597d\u4e16\u754c\u518d\u89c1\n--", 0), (2, "erheed titionly\n--", 1), (3, "", 2)]


def test_likeness_of_long_repeated_texts():
    rng = random.Random(9)
    passage, other = (words_of(rng, 300)[:1500].encode() for _ in range(2))
    a, b = passage * 5000, passage * 3300 + other * 1700
    x, y = (fingerprint.paragraph_vector(t)[fingerprint.DENSE:].astype(float) for t in (a, b))
    assert np.abs(x).max() > 1 << 15
    got = fingerprint.likeness(fingerprint.Fingerprint.of(a), fingerprint.Fingerprint.of(b))
    assert got == pytest.approx(max(0.0, x @ y / np.sqrt((x @ x) * (y @ y))))
    junk = [fingerprint.Fingerprint.of(b"ab " * n) for n in (33_000, 30_000)]
    assert fingerprint.likeness(*junk) > 0.999


def test_every_notice_of_a_long_file_has_its_label(spark):
    whole = " and some words between ".join(w for _, _, w in licenses.TEMPLATES)
    some = [" ".join(w for label, _, w in licenses.TEMPLATES if label in chosen)
            for chosen in (("lgpl", "agpl", "bsd", "cc-by"), ("bsd", "isc", "mpl", "unlicense", "cc-by"))]
    rows = spark.createDataFrame(list(enumerate([whole, *some, "the work of copy"])), "doc_id long, text string")
    got = {i: set(t.split(",")) for i, t in collected(licenses.scan(rows), "doc_id", "labels")}
    assert got[0] == {label for label, *_ in licenses.TEMPLATES}
    assert got[1] >= {"lgpl", "agpl", "bsd", "cc-by"} and got[2] >= {"bsd", "isc", "mpl", "unlicense", "cc-by"}
    assert got[3] == {""}


def test_pipeline_stage_keeps_one_of_texts_with_similar_shingles(spark):
    rng = random.Random(14)
    made = []
    for _ in range(20):
        w = words_of(rng, 200).split()
        copy = list(w)
        copy[60], copy[140] = "changed", "other"
        made += [" ".join(w), " ".join(copy)]
    rows = stored(spark.createDataFrame(list(enumerate([*made, None, "", "one two"])), "doc_id long, text string"))
    assert simhash.keep_one(rows).count() > 26
    kept = sorted(r["doc_id"] for r in simhash.keep_one(rows, least=0.8).collect())
    assert kept == [*range(0, 40, 2), 40, 42]


def test_pairs_in_columns():
    rng = random.Random(8)
    texts = ["", "a"]
    for _ in range(300):
        a = "".join(rng.choices("abcd ü界", k=rng.choice([1, 5, 63, 64, 65, 128, 129, 200, 255, 257, 300])))
        texts += [a, "".join(c for c in a if rng.random() < 0.9), a[:-len(a) // 3 or None] + "dcba"]
    coded = edits.Coded(texts)
    u = np.array([rng.randrange(len(texts)) for _ in range(900)] + list(range(len(texts) - 1)))
    v = np.concatenate([[rng.randrange(len(texts)) for _ in range(900)], np.arange(1, len(texts))])
    for share in (0.0, 0.05, 0.2, 0.5):
        allowed = share * np.maximum(coded.size[u], coded.size[v]) + 1e-9
        good, left = edits.within_columns(coded, u, v, allowed)
        want = np.array([lines.edit_distance(texts[a], texts[b], m) <= m for a, b, m in zip(u, v, allowed)])
        assert 0 < left.sum() < len(u) / 2 and not (good[~left] != want[~left]).any()
        assert lines.close(coded, texts, u, v, 1 - share, False).tolist() == want.tolist()


def test_links_of_many_clusters_at_once():
    """The groups are those of all similar pairs inside clusters, whatever the turns and however long the lines are."""
    rng = random.Random(12)
    texts, starts, sides = [], [], []
    for size in [2] * 40 + [5] * 20 + [60, 30]:
        starts.append(len(texts))
        base = words_of(rng, rng.choice([3, 12, 40, 120]))
        for _ in range(size):
            texts.append(" ".join(w if rng.random() < 0.85 else words_of(rng, 1) for w in base.split(" ")))
        sides += [0] * size if size != 30 else [0, 1] * 15
    ends, n = starts[1:] + [len(texts)], len(texts)
    for least in (0.8, 0.9):
        a, b = lines.verified(np.array(starts), np.arange(n), np.zeros(n, np.uint64), np.array(sides), texts, None, least)
        pairs = [(i, j) for s, e in zip(starts, ends) for j in range(s, e) for i in range(s, j)
                 if (sides[i] != sides[j] or e - s != 30) and lines.similar(texts[i], texts[j], least)]
        assert len(pairs) > 20
        assert least_labels(a, b, n).tolist() == least_labels(*(np.array(x) for x in zip(*pairs)), n).tolist()
        assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} <= set(pairs)


def test_parsed_lines_are_those_of_each_line_alone():
    rng = random.Random(23)
    texts = [b"", b"\n", b"--\n a b\n\nc--", "\u00dcn\u00ef 18 \u754c\r\n x\ty\n".encode(), b"a" * 300 + b" b" * 600 + b"\n\n"]
    texts += [words_of(rng, 30).replace("a ", "\n").encode() for _ in range(20)]
    want = [(k, n, lines.normal(x)) for k, t in enumerate(texts) for n, x in enumerate(t.split(b"\n")) if lines.normal(x)]
    some = lines.Parsed(texts)
    assert [*zip(some.which, some.number, some.sizes, some.lines)] == [(k, n, len(w), b" ".join(w)) for k, n, w in want]
    for a, b in zip(lines.Hasher().parsed(some), lines.Hasher().lines([w for _, _, w in want])):
        assert a.tolist() == b.tolist()
    for nothing in ([], [b"-- \n"]):
        assert not lines.Parsed(nothing).lines and not len(lines.Hasher().parsed(lines.Parsed(nothing))[1])


def test_parcels_hold_all_keys_that_repeat(monkeypatch):
    monkeypatch.setattr(lines, "PARCELLED", 500)
    rng = np.random.default_rng(3)
    found = [(rng.integers(-900, 900, 90), rng.integers(0, 40, 90)) for _ in range(30)] + [(np.zeros(0, np.int64),) * 2]
    parts = {}
    for batch in lines.parcels(iter(found), 5):
        for part, row in zip(batch["part"].to_pylist(), range(batch.num_rows)):
            parts.setdefault(part, []).append(batch.slice(row, 1))
    got = [pair for batches in parts.values() for pair in zip(*(x.tolist() for x in lines.repeated(batches)))]
    keys, values = map(np.concatenate, zip(*found))
    often = {k for k, n in zip(*np.unique(keys, return_counts=True)) if n > 1}
    assert len(parts) == 5 and sorted(got) == sorted({(k, n) for k, n in zip(keys.tolist(), values.tolist()) if k in often})


def test_steps_that_no_job_reads_any_more_go(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(lines, "stored", lambda df: steps.append(stored(df)) or steps[-1])
    rows = stored(spark.createDataFrame(list(enumerate(similar_lines(random.Random(2), 20))), "doc_id long, text string"))
    found = lines.occurrences(rows.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), 1)
    links = lines.line_links(rows, stored(found.select("line", "fp")), None)
    assert links.count() > 0
    files = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step._stored) for step in steps]
    there = [f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(f) for f in files]
    assert len(there) == 4 + lines.PARTS and there == [False] * 4 + [True] * lines.PARTS


def test_a_pair_of_several_clusters_is_tried_once(monkeypatch):
    rng = random.Random(17)
    made = [" ".join(words_of(rng, 1) if rng.random() < 0.1 else w for w in base.split(" "))
            for base in (words_of(rng, 12), words_of(rng, 90)) for _ in range(8)]
    held = [[*range(8)], [*range(2, 8)], [*range(8, 16)], [0, 1, 2, 9], [*range(9, 16)]]
    rows = np.array([k for cluster in held for k in cluster])
    starts = np.cumsum([0] + [len(cluster) for cluster in held[:-1]])
    tried, close = [], lines.close

    def seen(coded, texts, u, v, *rest):
        tried.extend(zip(u.tolist(), v.tolist()))
        return close(coded, texts, u, v, *rest)

    monkeypatch.setattr(lines, "close", seen)
    monkeypatch.setattr(lines, "BATCH_PAIRS", 3)
    texts = [made[k] if k not in rows[:at] else None for at, k in enumerate(rows.tolist())]
    zero = np.zeros(len(rows), np.int64)
    a, b = lines.verified(starts, rows, zero.view(np.uint64), zero, texts, None, 0.8)
    assert len(tried) == len(set(map(frozenset, tried))) > 10
    pairs = {(i, j) for cluster in held for i in cluster for j in cluster if i < j and lines.similar(made[i], made[j])}
    assert least_labels(a, b, 16).tolist() == least_labels(*map(np.array, zip(*pairs)), 16).tolist()


def test_long_pairs_in_columns():
    rng = random.Random(19)
    texts = []
    for size in [300] * 120 + [700] * 80 + [2_000] * 40:
        a = "".join(rng.choices("abcdefg ü", k=size + rng.randrange(60)))
        share = rng.choice([0.05, 0.15, 0.3, 0.5])
        b = "".join(rng.choice(["", c + "x", "y"]) if rng.random() < share else c for c in a)
        texts += [a, rng.choice([b, b[len(b) // 10:], a[:size // 2] + b[::-1][:size // 2]])]
    coded = edits.Coded(texts)
    u, v = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    for share in (0.1, 0.2, 0.3):
        allowed = share * np.maximum(coded.size[u], coded.size[v]) + 1e-9
        good, left = edits.within_columns(coded, u, v, allowed)
        want = np.array([lines.edit_distance(texts[a], texts[b]) <= m for a, b, m in zip(u, v, allowed)])
        assert left.mean() < 0.5 and 20 < want.sum() < 220 and not (good[~left] != want[~left]).any()
        moved = np.bitwise_count(edits.triple_bits(coded)[u] ^ edits.triple_bits(coded)[v]).sum(1)
        assert (moved[want] <= 6 * allowed[want]).all()


def test_shuffle_files_of_a_stored_step_go(spark):
    def files():
        import gc
        import time
        gc.collect()
        time.sleep(0.5)
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle")}

    df = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    before = files()
    got = stored(df.repartition(7, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    assert not files() - before and got.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
