"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import keep

BITS = 64
#: Shingles whose bits are counted at once: bounds the memory that one very long text takes.
BLOCK = 1 << 15
#: Members of a bucket that one task compares directly; larger buckets are split by their free bits first.
DIRECT = 4096


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles of the whole text, repeats included.

    A bit is set if it is set in more than half of the shingles' XXH64 values. Null and empty texts give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks, one at least of which is zero on any ``radius`` given positions.

    Position i has a vector in {0,1}^(radius+1); mask v holds the positions whose vector has odd inner product with
    v. The vectors of ``radius`` positions span less than the whole space, so some v is orthogonal to them all.
    """
    top = 1 << (radius + 1)
    of = [i % (top - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (of[i] & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the distinct values ``x`` under Hamming distance: breadth-first, each value leaves once."""
    left, froms, tos = x, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        root = queue[0]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                queue.extend(found)
                left = left[~near]
                tos.append(found)
                froms.append(np.full(len(found), root, x.dtype))
    none = np.zeros(0, x.dtype)
    return (np.concatenate(froms), np.concatenate(tos)) if tos else (none, none)


def _bucket_links(keys: list[str], radius: int, direct: int | None):
    """A mapInArrow function over rows sorted by ``keys``: links within each bucket, or its rows if over ``direct``.

    Output: kind 0 with (a, b) linked, kind 1 with a member b of a bucket too large for one task, and its table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["kind", "tab", "a", "b"]

        def out(kind: int, tab: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(tab.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets: rows are (keys..., fp) columns, sorted."""
            k, fp = rows[:, :-1], rows[:, -1].view(np.uint64)
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]).any(axis=1)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(k)))
            two = starts[sizes == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            froms, tos, big = [a[near]], [b[near]], []
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                if direct is not None and n > direct:
                    big.append((s, n))
                    continue
                x, y = _linked(fp[s : s + n], radius)
                froms.append(x)
                tos.append(y)
            a, b = np.concatenate(froms), np.concatenate(tos)
            if len(a):
                yield out(0, np.zeros(len(a)), a, b)
            for s, n in big:
                yield out(1, k[s : s + n, 0], k[s : s + n, 1].copy(), fp[s : s + n])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "fp"]])
            last = np.flatnonzero((rows[:, :-1] != rows[-1, :-1]).any(axis=1))
            if len(last) or held and (held[-1][-1, :-1] != rows[0, :-1]).any():
                cut = last[-1] + 1 if len(last) else 0
                whole = np.concatenate([*held, rows[:cut]]) if held else rows[:cut]
                if len(whole):
                    yield from solve(whole)
                held = [rows[cut:]]
            else:
                held.append(rows)
        if held:
            yield from solve(np.concatenate(held))

    return run


def links(values: DataFrame, radius: int = 4, direct: int = DIRECT) -> DataFrame:
    """(a, b): links that connect exactly the distinct values ``fp`` (signed long) connected at ``radius`` bits or fewer.

    Every value goes to one bucket of each covering table. Buckets over ``direct`` members are dealt out again by
    radius+1 blocks of the bits that the table's mask leaves free: a pair within the radius agrees on one block.
    """
    masks = covering_masks(radius)
    dealt = values.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("t")).select("t.tab", "t.k", "fp")
    kind = "kind int, tab int, a long, b long"
    first = keep(dealt.repartition("tab", "k").sortWithinPartitions("tab", "k", "fp").mapInArrow(_bucket_links(["tab", "k"], radius, direct), kind), "buckets")
    found = first.where("kind = 0").select("a", "b")
    over = first.where("kind = 1")
    if over.isEmpty():
        return found.distinct()
    rows = []
    for i, m in enumerate(masks):
        free = [p for p in range(BITS) if not m >> p & 1]
        blocks = [sum(1 << p for p in free[j :: radius + 1]) for j in range(radius + 1)]
        rows.append(F.array(*[F.struct(F.lit(i).alias("tab"), F.lit(j).alias("j"), F.col("b").bitwiseAND(F.lit(_signed(x | m))).alias("k")) for j, x in enumerate(blocks)]))
    pick = rows[-1]
    for i in range(len(rows) - 1):
        pick = F.when(F.col("tab") == i, rows[i]).otherwise(pick)
    again = over.select(F.explode(pick).alias("t"), F.col("b").alias("fp")).select("t.tab", "t.j", "t.k", "fp")
    more = again.repartition("tab", "j", "k").sortWithinPartitions("tab", "j", "k", "fp").mapInArrow(_bucket_links(["tab", "j", "k"], radius, None), kind)
    return found.union(keep(more, "subbuckets").select("a", "b")).distinct()


def clusters(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fp, component_id.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint 0 and are linked like others; rows with a null doc_id keep
    their row and take the component's smallest id (null if there is none); repeated rows each have a row; other
    columns are ignored; an empty table gives an empty result. Equal fingerprints are merged before any shuffle of
    buckets, so a group of copies costs one value.
    """
    fps = keep(fingerprints(docs, width), "fingerprints")
    nodes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("lo")), "values")
    roots = keep(components(links(nodes, radius), "a", "b"), "roots")
    placed = roots.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "lo")
    least = placed.groupBy("root").agg(F.min("lo").alias("least"))
    moved = placed.join(least, "root").select("fp", "least")
    ids = nodes.join(moved, "fp", "left").select("fp", F.coalesce("least", "lo").alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id; see :func:`clusters`."""
    return clusters(docs, width, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
