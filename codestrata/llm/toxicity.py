"""Toxicity scores from a convolutional text classifier trained in numpy."""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, stored, utf8

WIDTHS = (1, 2, 3)
FILTERS = 16
SIZE = 16
SLOTS = 1 << 15
CHUNK = 1 << 16
#: Bound of the labelled sample that the fit sees: rows, bytes of one text, bytes of all texts.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_BYTES = 10_000, 200_000, 48_000_000

FIND = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall  # letters: A-Z, a-z and all beyond ASCII

#: Common words of a language; the language of a text is the one with most of them.
COMMON = {k: frozenset(v) for k, v in {
    "en": b"the of and to in is that it for was with are this be on as by from".split(),
    "fr": "le la les des et du un une dans pour que qui est sur par pas avec au".encode().split(),
    "de": "der die das und den von zu mit sich des auf für ist nicht ein eine als dem".encode().split(),
    "es": "el los las y en que del un una por con para se al es como su lo".encode().split(),
}.items()}
LANGUAGES = [*COMMON, "other"]


def text_words(text: bytes) -> list[bytes]:
    """Runs of letters, folded to lower case as UTF-8 text."""
    return FIND(text.decode("utf-8", "replace").lower().encode())


def word_slots(word: bytes) -> tuple[int, int, int, int]:
    """Slots of the word, of its first four and five letters and of its last five."""
    text = word.decode("utf-8", "replace")
    return (crc32(word) % SLOTS, crc32(b"<" + text[:4].encode()) % SLOTS,
            crc32(b"<<" + text[:5].encode()) % SLOTS, crc32(b">" + text[-5:].encode()) % SLOTS)


def language_marks(word: bytes) -> list[int]:
    """For each language whether the word is one of its common words."""
    return [word in own for own in COMMON.values()]


@dataclass
class Model:
    """Embeddings of hashed word parts, filters over 1, 2 and 3 words, a linear head, a threshold per language."""

    slots: np.ndarray
    filters: list[np.ndarray]  # per width: width x SIZE x FILTERS
    bias: np.ndarray
    head: np.ndarray
    base: float
    thresholds: list[float] = field(default_factory=lambda: [0.0] * len(LANGUAGES))

    @classmethod
    def fresh(cls, seed: int = 1) -> "Model":
        r = np.random.default_rng(seed)
        return cls((r.normal(size=(SLOTS, SIZE)) * 0.1).astype(np.float32),
                   [(r.normal(size=(w, SIZE, FILTERS)) / np.sqrt(w * SIZE)).astype(np.float32) for w in WIDTHS],
                   np.zeros(len(WIDTHS) * FILTERS, np.float32),
                   (r.normal(size=len(WIDTHS) * FILTERS) * 0.1).astype(np.float32), 0.0)

    def word_tables(self, slots: np.ndarray) -> np.ndarray:
        """Response of each word to each filter at each place: words x (sum of widths) x FILTERS."""
        embedded = self.slots[slots].sum(1)
        return np.stack([embedded @ f for bank in self.filters for f in bank], 1)

    def responses(self, tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Filter responses at each place but the last two, which only close windows."""
        n, out, at = len(ids) - 2, [], 0
        for w in WIDTHS:
            total = tables[at][ids[:n]]
            for j in range(1, w):
                total = total + tables[at + j][ids[j:n + j]]
            out.append(total)
            at += w
        return np.concatenate(out, 1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.head + self.base


class Scorer:
    """Scores texts; the filter responses of recent words are kept, up to about ``keep`` of them."""

    def __init__(self, model: Model, keep: int = 60_000):
        self.model, self.keep = model, keep
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        # Row 0 stands before and after every text.
        self.tables = [np.zeros((4096, FILTERS), np.float32) for _ in range(sum(WIDTHS))]
        self.marks = np.zeros((4096, len(COMMON)), np.int32)

    def learn(self, first: int, new: list[bytes]) -> None:
        stop = first + len(new)
        if stop > len(self.marks):
            more = max(stop, 2 * len(self.marks)) - len(self.marks)
            self.tables = [np.concatenate([t, np.zeros((more, FILTERS), np.float32)]) for t in self.tables]
            self.marks = np.concatenate([self.marks, np.zeros((more, len(COMMON)), np.int32)])
        made = self.model.word_tables(np.array([word_slots(w) for w in new]))
        for k, t in enumerate(self.tables):
            t[first:stop] = made[:, k]
        self.marks[first:stop] = [language_marks(w) for w in new]

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over each whole text, and the text's language.

        The language is that with most common words; a text without any is of the last, 'other'.
        """
        if len(self.ids) > self.keep:
            self.reset()
        known = self.ids
        first = len(known) + 1
        new = [w for w in dict.fromkeys(chain.from_iterable(texts)) if w not in known]
        for i, w in enumerate(new, first):
            known[w] = i
        if new:
            self.learn(first, new)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + 2) - lengths
        ids = np.zeros(int(lengths.sum()) + 2 * len(texts) + 4, np.int64)
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        ids[at] = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        counts = np.zeros((len(texts), len(COMMON)), np.int64)
        last = len(ids) - 2
        for a in range(0, last, CHUNK):
            b = min(a + CHUNK, last)
            begin, end = np.searchsorted(starts, [a, b], "left")
            rows = np.arange(max(0, begin - 1), end)  # the text before may reach into this chunk
            rows = rows[starts[rows] + lengths[rows] + 2 > a]
            if len(rows):
                cuts = np.maximum(starts[rows], a) - a
                got = self.model.responses(self.tables, ids[a:b + 2])
                got[ids[a:b] == 0] = -np.inf  # windows begin at words; one that begins behind a text reaches the next
                pooled[rows] = np.maximum(pooled[rows], np.maximum.reduceat(got, cuts))
                counts[rows] += np.add.reduceat(self.marks[ids[a:b]], cuts)
        pooled[lengths == 0] = 0
        spoken = np.where(counts.any(1), counts.argmax(1), len(COMMON))
        return pooled, spoken

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0), np.zeros(0, np.int64)
        pooled, spoken = self.read(texts)
        return self.model.logit(pooled), spoken


class Coder:
    """Numbers words from 1 on, so that a sample is held as small numbers and each word once."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def code(self, text: bytes) -> np.ndarray:
        number = self.number
        words = text_words(text)
        return np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int32, len(words))


def fit(coded: list[np.ndarray], vocabulary: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.08,
        seed: int = 1) -> Model:
    """Adaptive gradient descent; the gradient reaches only the window that won each filter's maximum.

    Without two classes there is nothing to tell apart: the head is zero, and every text is clean, or toxic if all labels are.
    """
    model, r = Model.fresh(seed), np.random.default_rng(seed)
    if not 0 < labels.sum() < len(labels):
        model.head[:] = 0
        model.base = 1.0 if len(labels) and labels.all() else -1.0
        return model
    share = max(labels.mean(), 1e-3)
    model.base = float(np.log(share / (1 - min(share, 0.999))))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3))
    coded = [np.pad(c, (0, max(2, 3 - len(c)))) for c in coded]
    slots = np.array([(0, 0, 0, 0)] + [word_slots(w) for w in vocabulary], np.int32)
    sums = {k: np.full_like(v, 1e-6) for k, v in
            (("slots", model.slots), ("bias", model.bias), ("head", model.head))}
    bank_sums = [np.full_like(f, 1e-6) for f in model.filters]
    base_sum = 1e-6
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = r.permutation(len(coded))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            local, flat = np.unique(np.concatenate([coded[i] for i in rows]), return_inverse=True)
            embedded = model.slots[slots[local]].sum(1)
            embedded[local == 0] = 0
            tables = [embedded @ f for bank in model.filters for f in bank]
            ends = np.cumsum([len(coded[i]) for i in rows])
            best = np.zeros((len(rows), len(WIDTHS) * FILTERS), np.int64)
            pooled = np.zeros(best.shape, np.float32)
            for k, end in enumerate(ends):
                begin = end - len(coded[rows[k]])
                got = model.responses(tables, flat[begin:end])
                top = got.argmax(0)
                best[k], pooled[k] = top + begin, got[top, np.arange(got.shape[1])]
            hidden = np.maximum(pooled + model.bias, 0)
            keep = r.random(hidden.shape) > 0.2
            p = 1 / (1 + np.exp(-np.clip((hidden * keep) @ model.head * 1.25 + model.base, -30, 30)))
            g = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g_head = (hidden * keep).T @ g
            g_hidden = g[:, None] * model.head[None, :] * (hidden > 0) * keep
            g_words = np.zeros_like(embedded)
            col = 0
            for k, w in enumerate(WIDTHS):
                gw = g_hidden[:, col:col + FILTERS]
                where = best[:, col:col + FILTERS]
                for j in range(w):
                    ids = flat[where + j]
                    g_filter = np.einsum("bf,bfd->df", gw, embedded[ids])
                    np.add.at(g_words, ids, gw[:, :, None] * model.filters[k][j].T[None])
                    bank_sums[k][j] += g_filter ** 2
                    model.filters[k][j] -= step * g_filter / np.sqrt(bank_sums[k][j])
                col += FILTERS
            g_words[local == 0] = 0
            moved = np.nonzero(np.abs(g_words).sum(1))[0]
            spread = slots[local[moved]]
            used, back = np.unique(spread, return_inverse=True)
            g_slots = np.zeros((len(used), SIZE), np.float32)
            np.add.at(g_slots, back.reshape(spread.shape), g_words[moved][:, None, :])
            sums["slots"][used] += g_slots ** 2
            model.slots[used] -= step * g_slots / np.sqrt(sums["slots"][used])
            sums["head"] += g_head ** 2
            model.head -= step * g_head / np.sqrt(sums["head"])
            g_bias = g_hidden.sum(0)
            sums["bias"] += g_bias ** 2
            model.bias -= step * g_bias / np.sqrt(sums["bias"])
            base_sum += float(g.sum()) ** 2
            model.base -= step * float(g.sum()) / np.sqrt(base_sum)
    return model


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Logit with the largest F1, halfway to the next lower one."""
    order = np.argsort(-logits)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(f1.argmax())
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2)


def calibrate(model: Model, coded: list[np.ndarray], vocabulary: list[bytes], labels: np.ndarray,
              least: int = 25) -> None:
    """A threshold per language, over rows the weights have not seen.

    A language with under ``least`` toxic rows takes the threshold of all languages.
    """
    if not len(labels) or not 0 < labels.sum() < len(labels):
        return
    scorer = Scorer(model)
    parts = [scorer.logits([[vocabulary[i - 1] for i in c] for c in coded[at:at + 256]]) for at in range(0, len(coded), 256)]
    logits, spoken = (np.concatenate(x) for x in zip(*parts))
    overall = best_threshold(logits, labels)
    for k in range(len(LANGUAGES)):
        own = spoken == k
        enough = labels[own].sum() >= least and (1 - labels[own]).sum() >= least
        model.thresholds[k] = best_threshold(logits[own], labels[own]) if enough else overall


def remainder(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 is held out, 1 sets the thresholds, the rest sets the weights."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT,
          all_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows; rows with remainder 0 are never read.

    The sample is taken in the order of a hash of the id, whatever the layout of the tables: the first ``rows`` labelled ids,
    of these the texts of at most ``text_bytes`` bytes (one text per id, chosen by hash), up to ``all_bytes`` in all. Ids with
    contradicting labels count as toxic; null labels are no labels. Without labels of both kinds all texts get one score: 0.27
    (clean), or 0.73 if all labels are toxic.
    """
    place = F.xxhash64(F.col("doc_id"), F.lit(1))
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(remainder() != 0)
             .orderBy(place, "doc_id").limit(rows))
    sample = stored(
        docs.select("doc_id", F.col("text").cast("binary").alias("data"))
        .filter(F.col("data").isNotNull() & (F.octet_length("data") <= text_bytes))
        .join(F.broadcast(known), "doc_id")  # at most ``rows`` ids
        .groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("data").alias("hash"), "data")).alias("one"))
        .select("doc_id", place.alias("place"), (remainder() == 1).alias("tune"),
                (F.col("toxic") != 0).cast("int").alias("y"), F.col("one.data").alias("data")))
    size, coder, parts = 0, Coder(), {True: ([], []), False: ([], [])}
    for row in sample.orderBy("place", "doc_id").toLocalIterator():
        size += len(row.data)
        if size > all_bytes:
            break
        parts[row.tune][0].append(coder.code(bytes(row.data)))
        parts[row.tune][1].append(row.y)
    vocabulary = list(coder.number)
    model = fit(parts[False][0], vocabulary, np.array(parts[False][1]))
    if model.head.any():
        calibrate(model, parts[True][0], vocabulary, np.array(parts[True][1]))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``_row`` (all columns as a struct), ``score`` and ``language`` of every whole text."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(F.lit(0).alias("_"), *others).alias("_rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text", 1_000_000):
            logits, spoken = scorer.logits([text_words(t) for t in utf8(batch, "text")])
            shifted = logits - np.array(model.thresholds)[spoken]
            p = 1 / (1 + np.exp(-np.clip(shifted.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array([LANGUAGES[k] for k in spoken])],
                                             names=["text", "_rest", "score", "language"])

    done = rows.mapInArrow(run, rows.withColumns({"score": F.lit(0.0), "language": F.lit("")}).schema)
    row = F.struct(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns])
    return done.select(row.alias("_row"), "score", "language")


def score(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with ``score`` and ``language`` of every whole text.

    The score is the model's probability shifted so that 0.5 is the threshold of the language that the
    text's own common words show. Only the text enters. Null and empty texts get the score of
    no words; texts of any length are read whole, in chunks; repeated rows get equal scores; an
    empty table gives no rows; other columns are ignored.
    """
    names = [c for c in docs.columns if c in keep]
    done = scored(docs.select("text", *[c for c in names if c != "text"]), model)
    return done.select(*[F.col("_row")[c].alias(c) for c in names], "score", "language")


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a score under ``least``, all columns as they are."""
    clean = scored(docs, model).filter(F.col("score") < least)
    return clean.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
