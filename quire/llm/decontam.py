"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages they point at."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"
#: Words of a seed; of so many seeds in a row the rarest is looked up, so any copied run of GRAM + WINDOW - 1 words is found.
GRAM, WINDOW = 3, 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score over that of a perfect copy of the item from which a passage counts as a copy.
THRESHOLD = 0.5
#: Characters of the benchmark that one pass holds; a larger benchmark takes several passes over the documents.
BLOCK_CHARS = 4_000_000
#: Words of a text whose seeds are looked up at once.
SLICE = 1 << 18
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Bench:
    """A block of test items, ready for look-up."""

    ids: list[int | None]
    vocab: dict[str, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.codes, self.at = np.zeros(0, np.int64), []
        self.short: dict[tuple, list[int]] = defaultdict(list)  # items without a gram, by their words

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Bench:
        out = Bench([i for i, _ in rows])
        for _, text in rows:
            out.items.append(np.array([out.vocab.setdefault(w, len(out.vocab) + 1) for w in words(text)], np.int32))
        for i, item in enumerate(out.items):
            if 0 < len(item) < GRAM:
                out.short[tuple(item.tolist())].append(i)
        return out

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """A number for each GRAM words in a row; 0 where one of them is no word of the block."""
        base, n = np.int64(len(self.vocab) + 1), len(ids) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(GRAM):
            code = code * base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, code, 0)

    def numbered(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.vocab.get, w, _Zeros()), np.int32, len(w))

    def look_up(self, which: dict[int, list[tuple[int, int]]]) -> None:
        """Sets the seeds: code -> (item, place) pairs."""
        self.codes = np.array(sorted(which), np.int64)
        self.at = [which[c] for c in self.codes.tolist()]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in the text, seed number) of the seeds in a text."""
        if not len(self.codes):
            return
        for a in range(0, max(1, len(ids)), SLICE):
            g = self.grams(ids[a : a + SLICE + GRAM - 1])
            some = np.flatnonzero(g)
            k = np.minimum(np.searchsorted(self.codes, g[some]), len(self.codes) - 1)
            ok = self.codes[k] == g[some]
            yield from zip((some[ok] + a).tolist(), k[ok].tolist(), strict=True)


class _Zeros:
    """An endless row of zeros."""

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return 0


def all_grams(b: Bench) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, item in enumerate(b.items):
        for j, code in enumerate(b.grams(item).tolist()):
            out[code].append((i, j))
    return out


def rarest(b: Bench, frequency: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """The rarest gram (by documents that hold it; the first of equals) of every WINDOW grams in a row of an item."""
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, item in enumerate(b.items):
        codes = b.grams(item).tolist()
        n = [frequency.get(c, 0) for c in codes]
        for j in {min(range(s, min(s + WINDOW, len(codes))), key=lambda k: (n[k], k)) for s in range(max(1, len(codes) - WINDOW + 1))} if codes else ():
            out[codes[j]].append((i, j))
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, and the passage's first and last aligned places (Smith-Waterman, linear gaps)."""
    m = len(passage)
    prev, came = np.zeros(m + 1, np.int64), np.arange(m + 1)
    ramp = np.arange(m + 1) * -GAP
    best, first, last = 0, 0, 0
    for w in item:
        diag = prev[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        h, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
        take = diag > up
        h[1:] = np.maximum(0, np.where(take, diag, up))
        start[1:] = np.where(h[1:] > 0, np.where(take, came[:-1], came[1:]), start[1:])
        run = h + ramp
        top = np.maximum.accumulate(run)
        whence = np.maximum.accumulate(np.where(run == top, np.arange(m + 1), 0))
        h, start = top - ramp, start[whence]
        start = np.where(h > 0, start, np.arange(m + 1))
        k = int(h.argmax())
        if h[k] > best:
            best, first, last = int(h[k]), int(start[k]), k - 1
        prev, came = h, start
    return best / max(1, MATCH * len(item)), first, last


def matches(b: Bench, ids: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first, last) of the items that the text holds a copy of: the best passage of each."""
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place, k in b.hits(ids):
        for i, j in b.at[k]:
            n = len(b.items[i])
            lo, hi = max(0, place - 2 * j - 8), min(len(ids), place + 2 * (n - j) + 8)
            spans = near[i]
            if spans and lo <= spans[-1][1]:
                spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
    out = [(i, 1.0, 0, len(ids) - 1) for i in b.short.get(tuple(ids.tolist()), ())] if len(ids) < GRAM else []
    for i, spans in sorted(near.items()):
        score, first, last = max(((s, lo + f, lo + e) for lo, hi in spans for s, f, e in [align(b.items[i], ids[lo:hi])]), key=lambda x: (x[0], -x[1]))
        if score >= threshold:
            out.append((i, score, first, last))
    return out


def benches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[Bench]:
    """The benchmark in blocks of at most about ``block_chars`` characters, each with its seeds.

    A first pass over all documents counts, for every gram of a block's items, the documents that hold it.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and text <> ''").distinct()
    blocks = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    out = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).sort("item_id", "text").collect() if blocks > 1 else items.sort("item_id", "text").collect()
        b = Bench.of([(r["item_id"], r["text"]) for r in rows])
        b.look_up(all_grams(b))

        def count(batches: Iterator[pa.RecordBatch], b: Bench = b) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(b.codes), np.int64)
            for batch in batches:
                for text in batch.column("text"):
                    held = list({k for _, k in b.hits(b.numbered(text.as_py()))})
                    n[held] += 1
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(b.codes[at]), pa.array(n[at])], ["code", "n"])

        held = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        b.look_up(rarest(b, dict(zip(held.column("code").to_pylist(), held.column("n").to_pylist(), strict=True))))
        out.append(b)
    return out


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: items that a document holds a copy of, and the best passage.

    score is the Smith-Waterman score of the item's and the passage's words (lower case) over that of a perfect copy;
    ties go to the first passage. A copied run of GRAM + WINDOW - 1 words always makes a passage a candidate; an
    item with fewer words than a gram has no seeds and is compared whole: a text that says just its words is a copy. Null and empty texts and items match nothing; repeated rows and null
    ids are compared like others; whole texts are read; other columns are ignored; empty tables give no rows.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    out = None
    for b in benches(docs, benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], b: Bench = b) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, b.ids[i], s, f, e) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for i, s, f, e in matches(b, b.numbered(t.as_py()), threshold)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that hold no copy of an item; see :func:`find`."""
    for b in benches(docs, benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], b: Bench = b) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matches(b, b.numbered(t.as_py()), threshold) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
