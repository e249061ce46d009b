"""Token counts by byte-pair merging on a heap and a linked list."""

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, utf8

#: White space as Unicode lists it, and the split of byte-level vocabularies.
SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
         rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(spare)}


class Counter:
    """Counts the tokens of words; the counts of recent words are kept, up to ``keep`` of them."""

    def __init__(self, path: str, keep: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        symbols: dict[str, int] = dict(letters)
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        # A symbol is a byte or 256 plus its place among the symbols that merges make.
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = symbols.setdefault(left + right, len(symbols))
            self.rank.setdefault(symbols[left] << 20 | symbols[right], len(self.result))
            self.result.append(made)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self.words = regex.compile(SPLIT).findall
        self.keep = keep
        self.known: dict[str, int] = {}

    def word(self, data: bytes) -> int:
        """Symbols left of one word: its bytes less one for each merge."""
        n = len(data)
        if n < 2:
            return n
        rank, result = self.rank, self.result
        at = list(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        get = rank.get
        for i in range(n - 1):
            r = get(at[i] << 20 | at[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            # Stale entry: one of the two symbols has been merged since.
            if at[i] < 0 or j >= n or get(at[i] << 20 | at[j]) != r:
                continue
            at[i] = made = result[r]
            at[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                r = get(made << 20 | at[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = get(at[h] << 20 | made)
                if r is not None:
                    heappush(heap, r << 32 | h)
        return left

    def piece(self, text: str) -> int:
        known, total = self.known, 0
        words = self.words(text)
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        for w in words:
            c = known.get(w)
            if c is None:
                c = self.word(w.encode())
                if len(w) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                    known[w] = c
            total += c
        return total

    def text(self, text: str) -> int:
        if self.cut is None:
            return self.piece(text)
        pieces = self.cut.split(text)
        return len(pieces) - 1 + sum(map(self.piece, pieces))


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text under a byte-level vocabulary file.

    A special token's string inside a text counts as one token. A null or empty text has no bytes and
    no tokens; repeated rows and null ids are counted row by row; an empty table gives no rows; other
    columns are ignored. One word costs time by its own length times its logarithm, so a text
    without any break is no special case. ``path`` must exist on the executors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches, "text"):
            texts = utf8(batch, "text")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([counter.text(t.decode("utf-8", "replace")) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
