"""De-duplication: groups of texts that share most of their five-word shingles.

SimHash by covering tables (4 bits or fewer, four-word shingles) and bands of minimum hashes only propose which texts
to compare; shingle sets decide, exactly, at a Jaccard similarity of 0.8. SimHash alone misses most pairs at 0.8:
their fingerprints differ in up to 15 bits, and no covering table reaches that radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .graph import components
from .store import drop, keep

SHINGLE, SIMILARITY = 5, 0.8
#: BANDS keys of ROWS minimum hashes each: two texts of similarity 0.8 share one with probability 0.9999.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BLOCK, REMEMBERED = 1 << 12, 80_000
#: Members of a bucket that one task goes through; larger buckets are dealt out. Bytes of shingle sets that a task holds.
HOT, HELD = 512, 32 << 20

_rng = np.random.default_rng(20)
_A, _B = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_P = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 61, 1 << 62, SHINGLE, dtype=np.int64)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """64-bit hashes of the five-word shingles of the whole text; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1) if len(w) else 0
    h = np.full(n, len(w) if len(w) < SHINGLE else 0, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h += w[k : k + n] * _P[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def sketch(h: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    lo, hi = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), BLOCK):
        out = np.minimum(out, (lo[at : at + BLOCK, None] * _A + hi[at : at + BLOCK, None] * _B).min(axis=0))
    return out


def band_keys(h: np.ndarray) -> list[int]:
    m = sketch(h)
    return [xxhash.xxh64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def _key(text: str) -> int:
    """Names a text's words by 64 bits; that two of 10^10 different texts share a name is expected about three times."""
    return xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split())) - (1 << 63)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key, keys): SimHash, what names the words, the bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            fp, key, keys = [], [], []
            for text in b.column("text"):
                t = text.as_py() or ""
                fp.append(simhash.fingerprint(t))
                key.append(_key(t))
                keys.append(band_keys(shingles(t, known)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(key, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "key", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, key long, keys array<long>")


def buckets(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(bucket, key) of the texts to compare: those that share a band's key, and those whose fingerprints are linked.

    A bucket is named by its members, so buckets of several bands with equal members are one; names that agree by
    chance only bring more texts together. ``near`` are the components (node, root) of fingerprints.
    """
    dealt = nodes.select("key", F.posexplode("keys").alias("band", "at"))
    rooted = nodes.select("key", "fp").join(near, F.col("fp") == F.col("node"), "left").select("key", F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("at"))
    dealt = dealt.union(rooted)
    named = dealt.groupBy("band", "at").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("n > 1")
    named = named.select("band", "at", F.xxhash64("n", "x", "y").alias("bucket"))
    return keep(dealt.join(named, ["band", "at"]).select("bucket", "key").distinct(), "shared")


def shingle_sets(docs: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, shingles): sorted shingle hashes of the texts that stand in a shared bucket, drawn once a text."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [t.as_py() or "" for t in b.column("text")[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(map(_key, texts), pa.int64()), pa.array([np.unique(shingles(t, known)).tobytes() for t in texts], pa.binary())], ["key", "shingles"])

    at = nodes.join(shared.select("key").distinct(), "key", "left_semi").select(F.col("lo").alias("__at"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(at, F.col("doc_id").eqNullSafe(F.col("__at")), "left_semi")
    return keep(rows.select("text").mapInArrow(draw, "key long, shingles binary").dropDuplicates(["key"]), "shingles")


class _Held:
    """Sorted shingle sets held for comparison: an inverted index of most, and those added since it was made."""

    def __init__(self):
        self.names: list[tuple[int, int]] = []  # key, group
        self.sizes: list[int] = []
        self.flat, self.owner, self.indexed, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        self.fresh: list[np.ndarray] = []

    def add(self, name: tuple[int, int], x: np.ndarray) -> None:
        self.names.append(name)
        self.sizes.append(len(x))
        self.fresh.append(x)
        self.n += len(x)
        if self.n - len(self.flat) > max(4096, len(self.flat) // 2):
            flat = np.concatenate([self.flat, *self.fresh])
            owner = np.concatenate([self.owner, np.repeat(np.arange(self.indexed, len(self.names)), self.sizes[self.indexed :])])
            order = np.argsort(flat, kind="stable")
            self.flat, self.owner, self.indexed, self.fresh = flat[order], owner[order], len(self.names), []

    def similar(self, x: np.ndarray) -> np.ndarray:
        """Places of the held sets whose similarity to ``x`` is SIMILARITY or more."""
        if not self.names or not len(x):
            return np.zeros(0, np.int64)
        both = np.zeros(len(self.names), np.int64)
        if self.indexed:
            lo, n = np.searchsorted(self.flat, x), np.searchsorted(self.flat, x, "right")
            n -= lo
            total = int(n.sum())
            if total:
                both[: self.indexed] = np.bincount(self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total)], minlength=self.indexed)
        if self.fresh:
            f = np.concatenate(self.fresh)
            at = np.searchsorted(x, f)
            at[at == len(x)] = 0
            both[self.indexed :] = np.add.reduceat(x[at] == f, np.cumsum([0, *self.sizes[self.indexed : -1]]), dtype=np.int64)
        return np.flatnonzero(both >= SIMILARITY * (len(x) + np.array(self.sizes) - both) - 1e-9)


_FOUND = "kind int, a long, b long, part int, grp long, hold boolean"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        sets = (np.frombuffer(x.as_py(), np.uint64) for x in b.column("shingles"))
        yield from (r for r in zip(*[b.column(c).to_pylist() for c in names], sets, strict=True) if len(r[-1]))


def _lead(held_bytes: int):
    """Rows sorted by (bucket, part): links (kind 0) of each text with its part's leaders; a text without one leads.

    Rows for the next round (kind 1): the leaders of a bucket that is dealt out, and texts that resemble no leader
    once ``held_bytes`` of leaders are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, _Held(), []
        for bucket, part, key, parts, x in _rows(batches, ["bucket", "part", "key", "parts"]):
            if (bucket, part) != now:
                now, held = (bucket, part), _Held()
            near = held.similar(x)
            out.extend((0, held.names[i][0], key, 0, 0, True) for i in near.tolist())
            if not len(near):
                full = 8 * held.n > held_bytes
                if not full:
                    held.add((key, 0), x)
                if full or parts > 1:
                    out.append((1, bucket, key, 0, 0, True))
            if len(out) >= 8192:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    return run


def _across(held_bytes: int):
    """Rows sorted by (bucket, part), those to hold first: a link (kind 0) of each text with each other group it meets.

    Once ``held_bytes`` are held, what is left of the part is for the next round (kind 1), which holds the next ones.
    Held texts are compared with each other in part 0 only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, over, out = None, _Held(), False, []
        for bucket, part, key, grp, hold, x in _rows(batches, ["bucket", "part", "key", "grp", "hold"]):
            if (bucket, part) != now:
                now, held, over = (bucket, part), _Held(), False
            if not hold or part == 0:
                met = {grp}
                for i in held.similar(x).tolist():
                    other, of = held.names[i]
                    if of not in met:
                        met.add(of)
                        out.append((0, other, key, 0, 0, True))
            over = over or hold and 8 * held.n > held_bytes
            if over:
                out.append((1, bucket, key, part, grp, hold))
            elif hold:
                held.add((key, grp), x)
            if len(out) >= 8192:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    return run


def links(shared: DataFrame, sets: DataFrame, hot: int = HOT, held: int = HELD) -> DataFrame:
    """(a, b): keys of similar texts, each compared with the leaders of its buckets.

    A bucket of more than ``hot`` members is dealt out, and its parts' leaders meet in the next round, in parts
    ``hot`` times as large. Similarities are exact.
    """
    rows, size, out = shared, hot, None
    while True:
        many = rows.groupBy("bucket").count().where(F.col("count") > size).select("bucket", F.ceil(F.col("count") / size).cast("int").alias("of"))
        dealt = rows.join(many, "bucket", "left").select("key", "bucket", F.coalesce("of", F.lit(1)).alias("parts"))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).join(sets, "key")
        found = keep(dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key").mapInArrow(_lead(held), _FOUND), "led")
        new = found.where("kind = 0").select("a", "b").distinct()
        out = new if out is None else out.union(new)
        rows, size = found.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("key")).distinct(), size * hot
        if rows.isEmpty():
            return out


def links_across(shared: DataFrame, sets: DataFrame, grouped: DataFrame, hot: int = HOT, held: int = HELD) -> DataFrame:
    """(a, b): keys of similar texts that ``grouped`` (node, root) leaves apart though they share a bucket.

    Two texts that follow different leaders are not compared by :func:`links`. Here the texts of buckets that hold
    several groups are: the bucket's largest group streams, dealt out, past the held texts of all others.
    """
    placed = keep(shared.join(grouped, F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("root", "key").alias("grp")), "placed")
    groups_ = placed.groupBy("bucket", "grp").count()
    several = groups_.groupBy("bucket").agg(F.count("*").alias("groups"), F.max(F.struct("count", "grp")).alias("top")).where("groups > 1")
    several = several.select("bucket", F.col("top.grp").alias("top"), F.ceil(F.col("top.count") / hot).cast("int").alias("parts"))
    rows = placed.join(several, "bucket").withColumn("hold", F.col("grp") != F.col("top"))
    every = F.when(F.col("hold"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    rows, out = rows.select("bucket", "key", "grp", "hold", F.explode(every).alias("part")), None
    while True:
        full = rows.join(sets, "key").repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.desc("hold"), "key")
        found = keep(full.mapInArrow(_across(held), _FOUND), "across")
        new = found.where("kind = 0").select("a", "b").distinct()
        out = new if out is None else out.union(new)
        rows = found.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("key"), "part", "grp", "hold")
        if rows.isEmpty():
            return out


def groups(docs: DataFrame, hot: int = HOT, held: int = HELD) -> DataFrame:
    """doc_id, key, least for each row of ``docs``: its text's name and the smallest doc_id of its group.

    Groups are the components of links between texts whose shingle sets have a similarity of ``SIMILARITY`` or more,
    among texts that share a bucket: a band of minimum hashes, or fingerprints linked by SimHash at 4 bits.
    """
    drawn = keep(sketches(docs), "sketches")
    nodes = keep(drawn.groupBy("key").agg(F.min("doc_id").alias("lo"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    near = keep(components(simhash.links(nodes.select("fp").distinct()), "a", "b"), "roots")
    shared = buckets(nodes, near)
    sets = shingle_sets(docs, nodes, shared)
    joined = keep(components(links(shared, sets, hot, held), "a", "b", "groups"), "groups")
    more = links_across(shared, sets, joined, hot, held)
    if not more.isEmpty():
        joined = keep(components(joined.select("root", "node").union(more), "root", "node", "groups"), "groups")
    placed = joined.join(nodes.select("key", "lo"), F.col("node") == F.col("key")).select("key", "root", "lo")
    least = placed.groupBy("root").agg(F.min("lo").alias("least"))
    moved = placed.join(least, "root").select("key", "least")
    # kept, so that both sides of the last join come straight from an exchange and a hot text's rows can be split
    found = keep(nodes.select("key", "lo").join(moved, "key", "left").select("key", F.coalesce("least", "lo").alias("least")), "least")
    members = keep(drawn.select("doc_id", "key").join(found, "key").select("doc_id", "key", "least"), "members")
    drop(drawn, nodes, near, shared, sets, joined, found)
    return members


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each group stays: its smallest doc_id.

    Null and empty texts are copies of each other. Of rows that repeat a doc_id within a group one stays; a null
    doc_id stays only where its group has no other. Other columns are carried along; an empty table stays empty.
    """
    names = docs.columns
    found = groups(docs)
    stay = found.where("doc_id <=> least").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    ids = stay.select("__id").distinct()
    kept = docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")
    repeated = keep(found.groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id"), "repeated")
    if repeated.isEmpty():
        return kept

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_key(t.as_py() or "") for t in b.column("text")], pa.int64())], [*b.schema.names, "__key"])

    again = docs["doc_id"].eqNullSafe(repeated["__id"])
    once = kept.join(repeated, again, "left_anti")
    marked = kept.join(repeated, again, "left_semi").mapInArrow(keyed, docs.withColumn("__key", F.lit(0).cast("long")).schema)
    one = stay.groupBy(F.col("__id").alias("__of"), F.col("__key").alias("__own")).count()
    marked = marked.join(one, marked["doc_id"].eqNullSafe(one["__of"]) & (marked["__key"] == one["__own"]), "left_semi")
    first = marked.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(F.xxhash64(*names)))).where("__n = 1")
    return once.select(*names).union(first.select(*names))
