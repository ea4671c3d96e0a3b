"""Document scores by masked pseudo-likelihood of a bidirectional window network trained in numpy.

The softmax has two levels: the network gives a word's class, and in classes that words share the corpus' table of
all words, spelled byte by byte where it has none, gives the word. That table grows with the corpus and is joined.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

SCHEMA = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"
#: Token classes: the edge of a text, the most frequent words of the corpus, and the rest by ending and length.
CLASSES, ENDINGS = 256, 64
WORDS = CLASSES - ENDINGS - 1
#: Width of the network; passes over the counted windows; contexts a step; steps that a small corpus gets at least.
DIM, EPOCHS, STEP, RATE, LEAST_STEPS = 24, 12, 1024, 0.01, 600
#: Distinct words that a task counts before it hands them on, and whose classes it remembers; words that are scored at once.
COUNTED, REMEMBERED, SLICE = 400_000, 150_000, 1 << 20
#: Words whose spelling is worked out at once.
SPELLED = 1 << 15
#: What each counted word gives up to words that are not counted; words of a block of rows, and rows' entries.
DISCOUNT, BLOCK_WORDS, BLOCK_ENTRIES = 0.5, 1 << 18, 1 << 21
_BLOCK = "block long, doc_id array<long>, n array<long>, total array<double>, words array<long>, classes binary, spelled binary, size binary, at binary, times binary"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Vocabulary(dict):
    """Word -> class. Words that are not among the frequent ones share classes by a hash of ending and length."""

    def __init__(self, frequent: list[str]):
        super().__init__((w, i + 1) for i, w in enumerate(frequent))
        self.fixed = len(self)

    def __missing__(self, word: str) -> int:
        if len(self) > self.fixed + REMEMBERED:
            for w in list(self)[self.fixed :]:
                del self[w]
        h = 0
        for c in word[-2:]:
            h = (h * 31 + ord(c)) & 0xFFFF
        self[word] = k = 1 + WORDS + (h * 7 + min(len(word), 12)) % ENDINGS
        return k

    def classes(self, text: str | None) -> np.ndarray:
        """Classes of the words of the whole text between two edges."""
        return self.of(tokens(text))

    def of(self, w: list[str]) -> np.ndarray:
        out = np.zeros(len(w) + 2, np.int64)
        out[1:-1] = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
        return out


class Words(list):
    """The frequent words, with the table (word, n) of all words and what the shared classes hold of it."""

    def __init__(self, frequent: list[str], counted: DataFrame | None = None, known: Known | None = None):
        super().__init__(frequent)
        self.counted, self.known = counted, known or Known(np.full((256, 256), -np.log(256)), np.zeros((2, ENDINGS)))


@dataclass
class Known:
    """log p(byte | byte before), byte 0 being a word's edge; occurrences and distinct words of each shared class."""

    spelling: np.ndarray
    totals: np.ndarray

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """log p of each word's bytes and its end."""
        out = np.zeros(len(words))
        for i in range(0, len(words), SPELLED):
            some = words[i : i + SPELLED]
            a = np.frombuffer(b"\0" + b"\0".join(some) + b"\0", np.uint8)
            starts = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            out[i : i + SPELLED] = np.add.reduceat(self.spelling[a[:-1], a[1:]], starts)
        return out

    def within(self, shared: np.ndarray, n: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log p(word | its shared class): its discounted count, and what the class gave up times its spelling."""
        total, distinct = self.totals[:, shared]
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1))
            rest = np.log(np.where(total > 0, DISCOUNT * distinct / np.maximum(total, 1), 1.0))
        return np.logaddexp(own, rest + spelled)


def frequent(docs: DataFrame) -> Words:
    """The most frequent words of all documents, ties going to the smaller word, and the table of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        c: Counter = Counter()
        for b in batches:
            for text in b.column("text"):
                c.update(tokens(text.as_py()))
                if len(c) > COUNTED:
                    yield out(c)
                    c = Counter()
        yield out(c)

    words = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = keep(words, "words")
    top = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    return Words(top, words, _known(words, top))


def _known(words: DataFrame, top: list[str]) -> Known:
    """What shared classes hold: as many sums as there are pairs of bytes and classes, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, sums = Vocabulary(top), np.zeros(65536 + 2 * ENDINGS, np.int64)
        for b in batches:
            own = [(w, n) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True) if v[w] > WORDS]
            if not own:
                continue
            a = np.frombuffer(b"\0" + b"\0".join(w.encode() for w, _ in own) + b"\0", np.uint8).astype(np.int64)
            sums[:65536] += np.bincount(a[:-1] * 256 + a[1:], minlength=65536)
            k = np.array([v[w] - 1 - WORDS for w, _ in own])
            np.add.at(sums, 65536 + k, [n for _, n in own])
            np.add.at(sums, 65536 + ENDINGS + k, 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["at", "n"])

    got = words.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(65536 + 2 * ENDINGS)
    sums[got.column("at").to_numpy()] = got.column("n").to_numpy()
    c = sums[:65536].reshape(256, 256) + 0.05
    return Known(np.log(c / c.sum(axis=1, keepdims=True)), sums[65536:].reshape(2, ENDINGS))


def windows(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(context, target, n): how often each target stands between each left and right neighbour, in all documents.

    A task adds up its own windows in one array of CLASSES^3 cells and hands on the filled ones; the sums are bounded
    by that number of cells, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cells = Vocabulary(vocabulary), np.zeros(CLASSES**3, np.int32)
        waiting: list[np.ndarray] = []
        size = 0

        def add() -> None:
            code, n = np.unique(np.concatenate(waiting), return_counts=True)
            cells[code] += n.astype(np.int32)

        for b in batches:
            for text in b.column("text"):
                c = v.classes(text.as_py())
                if len(c) > 2:
                    waiting.append((c[:-2] * CLASSES + c[2:]) * CLASSES + c[1:-1])
                    size += len(c)
                if size > SLICE:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        at = np.flatnonzero(cells)
        for a in range(0, len(at), 1 << 18):
            k = at[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((k // CLASSES).astype(np.int32)), pa.array((k % CLASSES).astype(np.int32)), pa.array(cells[k].astype(np.int64))], ["context", "target", "n"])

    found = docs.select("text").mapInArrow(count, "context int, target int, n long")
    return found.groupBy("context", "target").agg(F.sum("n").alias("n"))


@dataclass
class Network:
    """log p(target | left, right): an embedding of each side, one hidden layer, a softmax over all classes."""

    left: np.ndarray
    right: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 42) -> Network:
        r = np.random.default_rng(seed)
        return Network(*(r.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32) for _ in range(3)), np.zeros(CLASSES, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.left, self.right, self.out, self.bias]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return np.tanh(self.left[context // CLASSES] + self.right[context % CLASSES])

    def logits(self, context: np.ndarray) -> np.ndarray:
        z = self.hidden(context) @ self.out.T + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, context: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-likelihood of ``counts`` (contexts x classes)."""
        h = self.hidden(context)
        z = h @ self.out.T + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        total = counts.sum(axis=1, keepdims=True)
        d = (p * (total / p.sum(axis=1, keepdims=True)) - counts) / total.sum()
        back = (d @ self.out) * (1 - h * h)
        left, right = np.zeros_like(self.left), np.zeros_like(self.right)
        np.add.at(left, context // CLASSES, back)
        np.add.at(right, context % CLASSES, back)
        return [left, right, d.T @ h, d.sum(axis=0)]

    def table(self) -> np.ndarray:
        """log p of every target in every context: (CLASSES^2, CLASSES)."""
        out = np.empty((CLASSES**2, CLASSES), np.float32)
        for a in range(0, len(out), 4096):
            out[a : a + 4096] = self.logits(np.arange(a, a + 4096))
        return out


def train(net: Network, context: np.ndarray, offsets: np.ndarray, targets: np.ndarray, n: np.ndarray) -> Network:
    """Adam over mini-batches of contexts, each with all targets counted in it; deterministic."""
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(context) // STEP)))
    r = np.random.default_rng(7)
    m, v, t = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()], 0
    for epoch in range(epochs):
        order = r.permutation(len(context))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), STEP):
            rows = order[a : a + STEP]
            counts = np.zeros((len(rows), CLASSES), np.float32)
            for i, k in enumerate(rows):
                s = slice(offsets[k], offsets[k + 1])
                counts[i, targets[s]] = n[s]
            t += 1
            for x, g, p, q in zip(net.arrays(), net.gradients(context[rows], counts), m, v, strict=True):
                p += 0.1 * (g - p)
                q += 0.001 * (g * g - q)
                x -= rate * (p / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-9)
    return net


def fit(docs: DataFrame) -> tuple[Words, Network]:
    """Vocabulary and network from all documents.

    Counts come from the whole corpus by two grouped sums. The windows' counts, at most CLASSES^3 cells however large
    the corpus, reach one task as at most CLASSES^2 rows, which trains the network.
    """
    vocabulary = frequent(docs)
    counted = keep(windows(docs, list(vocabulary)), "windows")
    rows = counted.groupBy("context").agg(F.sort_array(F.collect_list(F.struct("target", "n"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, size, targets, n = [], [], [], []
        for b in batches:
            flat = b.column("t").flatten()
            context.append(b.column("context").to_numpy())
            size.append(np.diff(b.column("t").offsets.to_numpy()))
            targets.append(flat.field("target").to_numpy().astype(np.uint8))
            n.append(flat.field("n").to_numpy().astype(np.float32))
        if not context:
            return
        at = np.concatenate(context)
        order = np.argsort(at)  # the rows' own order is Spark's
        starts = np.concatenate([[0], np.cumsum(np.concatenate(size))])
        k, c = np.concatenate(targets), np.concatenate(n)
        gather = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
        offsets = np.concatenate([[0], np.cumsum(np.diff(starts)[order])])
        net = train(Network.fresh(), at[order].astype(np.int64), offsets, k[gather], c[gather])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a in net.arrays()]), pa.array(range(4), pa.int32())], ["weights", "part"])

    got = {r["part"]: np.frombuffer(bytes(r["weights"]), np.float32) for r in rows.coalesce(1).mapInArrow(run, "weights binary, part int").collect()}
    if not got:
        return vocabulary, Network.fresh()
    return vocabulary, Network(*(got[i].reshape(CLASSES, DIM) for i in range(3)), got[3])


_tables: dict[bytes, np.ndarray] = {}


def _table(net: Network) -> np.ndarray:
    key = b"".join(a.tobytes()[:256] for a in net.arrays())
    if key not in _tables:
        _tables.clear()
        _tables[key] = net.table().ravel()
    return _tables[key]


def _blocks(docs: DataFrame, vocabulary: Words, net: Network) -> DataFrame:
    """Rows of ``docs`` in blocks: the sums of their classes, and how often each holds which word of a shared class."""
    known, frequent = vocabulary.known, list(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = Vocabulary(frequent), _table(net)
        words: dict[str, int] = {}
        ids, n, total, size, at, times = [], [], [], array("i"), array("i"), array("i")
        packed = zstandard.ZstdCompressor(level=1).compress

        def out() -> pa.RecordBatch:
            raw = [w.encode() for w in words]
            row = {
                "block": uuid.uuid4().int >> 65, "doc_id": list(ids), "n": list(n), "total": list(total), "words": np.array([xxhash.xxh64_intdigest(w, 42) for w in raw], np.uint64).view(np.int64),
                "classes": np.array([v[w] - 1 - WORDS for w in words], np.uint8).tobytes(), "spelled": known.spelled(raw).astype(np.float32).tobytes(), "size": packed(size.tobytes()), "at": packed(at.tobytes()), "times": packed(times.tobytes()),
            }
            for x in (words, ids, n, total, size, at, times):
                x.clear() if isinstance(x, dict) else x.__delitem__(slice(None))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row.values(), kinds, strict=True)], list(row))

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                w = tokens(text.as_py())
                c = v.of(w)
                own = Counter([w[i] for i in np.flatnonzero(c[1:-1] > WORDS)])
                ids.append(doc_id)
                n.append(len(w))
                total.append(float(table[(c[:-2] * CLASSES + c[2:]) * CLASSES + c[1:-1]].sum(dtype=np.float64)))
                size.append(len(own))
                at.extend(words.setdefault(x, len(words)) for x in own)
                times.extend(own.values())
                if len(words) >= BLOCK_WORDS or len(at) >= BLOCK_ENTRIES:
                    yield out()
        if ids:
            yield out()

    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK), "blocks")


def score(docs: DataFrame, model: tuple[list[str], Network] | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood for each row of ``docs`` (doc_id, text).

    Every token is masked in turn and predicted: its class from its left and right neighbours, and the word within a
    shared class from the table of all words; log_likelihood sums the log-probabilities. A block of rows asks that
    table once a word. Null, empty and blank texts have no tokens, sum 0 and a null mean; whole texts are scored;
    repeated rows and null ids each have a row; other columns are ignored; an empty table gives no rows.
    """
    vocabulary, net = model or fit(docs)
    vocabulary = vocabulary if isinstance(vocabulary, Words) else Words(vocabulary)
    known, blocks = vocabulary.known, _blocks(docs, vocabulary, net)
    if vocabulary.counted is None:
        joined = blocks.withColumn("found", F.lit(None).cast("array<struct<pos:int,n:bigint>>"))
    else:
        asked = blocks.select("block", F.posexplode("words").alias("pos", "h"))
        found = asked.join(vocabulary.counted.select(F.xxhash64("word").alias("h"), "n"), "h").groupBy("block").agg(F.collect_list(F.struct("pos", "n")).alias("found"))
        joined = blocks.join(found, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(b.num_rows):
                classes, spelled = np.frombuffer(b.column("classes")[i].as_py(), np.uint8), np.frombuffer(b.column("spelled")[i].as_py(), np.float32)
                size, at, times = (np.frombuffer(unpacked(b.column(c)[i].as_py()), np.int32) for c in ("size", "at", "times"))
                n = np.zeros(len(classes))
                found = b.column("found")[i].values
                if found is not None:
                    n[found.field("pos").to_numpy()] = found.field("n").to_numpy()
                each = known.within(classes.astype(np.int64), n, spelled)[at]
                each *= times
                total = b.column("total")[i].values.to_numpy().copy()
                some = size > 0
                if some.any():
                    total[some] += np.add.reduceat(each, (np.cumsum(size) - size)[some])
                count = b.column("n")[i].values.to_numpy()
                mean = [s / k if k else None for s, k in zip(total.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i].values, pa.array(count, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return joined.select("doc_id", "n", "total", "classes", "spelled", "size", "at", "times", "found").mapInArrow(run, SCHEMA)
