"""Approximate nearest neighbours: a navigable small-world graph per shard, kept as flat neighbour arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Vectors of a shard and queries of a block, on average: they bound a task's memory.
SHARD, BLOCK = 4096, 1024
#: Links of a node (twice as many on the lowest level), candidates they are chosen from, candidates of a search.
LINKS, CONSTRUCT, SEARCH = 16, 96, 128
_INDEX = "shard int, dim int, n int, ids binary, copies binary, vectors binary, graph binary, sizes array<int>"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part.

    Null ids, null, empty or zero vectors, and vectors that hold nulls or non-finite numbers take no part.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where("vec_id is not null and embedding is not null").where(~bad & F.exists("embedding", lambda x: x != 0))


def frame(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, scale) of a shard's vectors: in it they lie around zero and reach one, wherever and how large they are."""
    low, high = x.min(axis=0), x.max(axis=0)
    centre = low / 2 + high / 2
    scale = float(np.abs(x - centre).max(initial=0))
    return centre, scale if scale > 0 else 1.0


def within(x: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    """Vectors in a shard's frame, in double precision; what lies far outside stays finite."""
    return np.clip(x / scale - centre / scale, -1e100, 1e100)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis in double precision, also where squares would overflow or vanish."""
    d = q - x
    m = np.abs(d).max(axis=-1)
    out = np.sqrt((d * d).sum(axis=-1))
    odd = (m > 1e150) | (m < 1e-150) & (m > 0)
    if odd.any():
        out[odd] = m[odd] * np.sqrt(((d[odd] / m[odd][:, None]) ** 2).sum(axis=-1))
    return out


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, nearest first."""
    n = len(x)
    out = np.empty((n, k), np.int32)
    half = (x * x).sum(axis=1) / 2
    for at in range(0, n, 512):
        d = half[None, :] - x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n else np.argsort(d, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable")
        out[at : at + 512] = np.take_along_axis(near, order, axis=1)
    return out


def _level(x: np.ndarray, links: int) -> np.ndarray:
    """Flat neighbours (n x width, -1 for none) of one level's nodes.

    Of the nearest candidates a node keeps those that are nearer to it than to a neighbour kept before; free places
    go to the nearest left over, and links are made both ways while the other side has room.
    """
    n, width = len(x), 2 * links
    out = np.full((n, width), -1, np.int32)
    if n < 2:
        return out
    near = _nearest(x, min(CONSTRUCT, n - 1))
    kept = np.zeros(near.shape, bool)
    own = ((x[near] - x[:, None, :]) ** 2).sum(axis=2) if n <= 512 else np.concatenate([((x[near[a : a + 512]] - x[a : a + 512, None, :]) ** 2).sum(axis=2) for a in range(0, n, 512)])
    chosen = np.full((n, links), -1, np.int32)
    count = np.zeros(n, np.int64)
    rows = np.arange(n)
    for j in range(near.shape[1]):
        c = near[:, j]
        ok = count < links
        for k in range(min(links, j)):
            has = ok & (chosen[:, k] >= 0)
            if not has.any():
                break
            r = rows[has]
            ok[r] = ((x[c[r]] - x[chosen[r, k]]) ** 2).sum(axis=1) > own[r, j]
        r = rows[ok]
        chosen[r, count[r]] = c[r]
        count[r] += 1
        kept[r, j] = True
    fill = np.argsort(~kept, axis=1, kind="stable")[:, :links]
    picked = np.take_along_axis(near, fill, axis=1)
    out[:, : picked.shape[1]] = picked
    free = np.full(n, picked.shape[1])
    for j in range(picked.shape[1]):  # nearest links first; of several that meet one node in a round, all that fit
        order = np.flatnonzero(~(picked[picked[:, j]] == np.arange(n)[:, None]).any(axis=1))
        order = order[np.argsort(picked[order, j], kind="stable")]
        to = picked[order, j]
        place = free[to] + np.arange(len(to)) - np.searchsorted(to, to)
        fits = place < width
        out[to[fits], place[fits]] = order[fits]
        np.add.at(free, to[fits], 1)
    return out


def build(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(order of the rows, sizes of the levels, flat neighbours of all levels).

    Rows are ordered by falling top level, so that the nodes of each level are the first ``size`` rows. A node's top
    level is geometric in a hash of its id, so a repeated task builds the same graph.
    """
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (ids.astype(np.uint64) >> np.uint64(29))
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)
    top = np.floor(-np.log((h.astype(np.float64) + 1) / 2.0**53) / np.log(LINKS)).astype(np.int64)
    order = np.lexsort((ids, -top))
    x, top = x[order], top[order]
    sizes = [len(x)] + [int((top >= level).sum()) for level in range(1, int(top.max(initial=0)) + 1)]
    return order, sizes, np.concatenate([_level(x[:n], LINKS).ravel() for n in sizes])


def search(x: np.ndarray, sizes: list[int], graph: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """Rows found for each query (-1 for none), ``width`` of them: greedy above, best-first on the lowest level.

    All queries step together: each expands its nearest candidate that it has not expanded yet, until none is left
    among its ``width`` nearest.
    """
    m, arity = len(q), 2 * LINKS
    levels, at = [], 0
    for n in sizes:
        levels.append(graph[at : at + n * arity].reshape(n, arity))
        at += n * arity
    rows = np.arange(m)
    cur = np.zeros(m, np.int64)
    dist = ((q - x[0]) ** 2).sum(axis=1)
    for level in levels[:0:-1]:
        active = rows
        while len(active):
            near = level[cur[active]]
            d = ((q[active, None, :] - x[near]) ** 2).sum(axis=2)
            d[near < 0] = np.inf
            best = d.argmin(axis=1)
            value = d[np.arange(len(active)), best]
            better = value < dist[active]
            active = active[better]
            cur[active] = near[better, best[better]]
            dist[active] = value[better]
    found = np.full((m, width), -1, np.int64)
    far = np.full((m, width), np.inf, q.dtype)
    done = np.ones((m, width), bool)
    found[:, 0], far[:, 0], done[:, 0] = cur, dist, False
    seen = np.zeros((m, len(x) + 1), bool)
    seen[rows, cur] = True
    active = rows
    while len(active):
        score = np.where(done[active], np.inf, far[active])
        pick = score.argmin(axis=1)
        live = np.isfinite(score[np.arange(len(active)), pick])
        active, pick = active[live], pick[live]
        if not len(active):
            break
        done[active, pick] = True
        near = levels[0][found[active, pick]]
        d = ((q[active, None, :] - x[near]) ** 2).sum(axis=2)
        d[(near < 0) | seen[active[:, None], near]] = np.inf
        seen[active[:, None], near] = True
        all_far = np.concatenate([far[active], d], axis=1)
        best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[active] = np.take_along_axis(all_far, best, axis=1)
        found[active] = np.take_along_axis(np.concatenate([found[active], near], axis=1), best, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(d.shape, bool)], axis=1), best, axis=1)
    found[~np.isfinite(far)] = -1
    return found


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): each distinct usable vector once, with its ``k`` + 1 smallest vec_ids in order.

    More copies can't be among the ``k`` nearest of any query, whose own vec_id may be one of them. Copies beyond these
    are left out before the shuffle. Of rows that repeat a vec_id the smallest vector is kept.
    """
    once = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    return first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def index(distinct: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """One row a shard, for :func:`distinct_vectors`: ids, how many each vector has, vectors and neighbours, flat.

    A vector's shard is a hash of its smallest id, so that shards are even whatever the data; vectors of another
    dimension are in shards of their own.
    """
    shards = max(1, -(-distinct.count() // shard_rows))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard, dim = key
        t = t.combine_chunks()
        flat = t.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim.as_py())
        own = t.column("ids").to_pylist()
        least = np.array([x[0] for x in own], np.int64)
        order = np.argsort(least)
        least, flat = least[order], flat[order]
        inner, sizes, graph = build(least, within(flat, *frame(flat)))
        own, flat = [own[i] for i in order[inner]], flat[inner].astype("<f8")
        row = {"shard": [shard.as_py()], "dim": [dim.as_py()], "n": [len(own)], "ids": [np.concatenate(own).astype("<i8").tobytes()], "copies": [np.array([len(x) for x in own], "<i4").tobytes()], "vectors": [flat.tobytes()], "graph": [graph.astype("<i4").tobytes()], "sizes": [sizes]}
        return pa.table(row, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("graph", pa.binary()), ("sizes", pa.list_(pa.int32()))]))

    dealt = distinct.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim"), "ids", "embedding")
    return dealt.groupBy("shard", "dim").applyInArrow(run, _INDEX)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, width: int = SEARCH, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each query, by Euclidean distance.

    The query set is cut into blocks, which pass every shard's index one after another, and the shards' best are merged. Graphs are
    built and searched in double precision in their shard's own frame, so that neither an offset nor a scale of the
    vectors costs neighbours; scores are computed in double precision from the original vectors; ties go to the smaller vec_id. A query's own vec_id
    is no candidate, and only vectors of its dimension are. With fewer than ``k`` candidates all are returned. See
    :func:`usable` for rows that take no part; empty tables give an empty result.
    """
    built = keep(index(keep(distinct_vectors(usable(vectors), k), "vectors"), shard_rows), "index")
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // block_rows))
    block = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.size("embedding").alias("qdim")).agg(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v"))).alias("q"))
    last = built.agg(F.max("shard")).first()[0]
    if last is None:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # each shard's index and then the blocks come to one task: an index once, the queries, a hundredth of its kind, once a shard
    meets = block.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"), F.col("qdim").alias("dim"), "q")
    rows = built.withColumn("q", F.lit(None).cast(meets.schema["q"].dataType)).unionByName(meets, allowMissingColumns=True)
    rows = rows.repartition(max(8, 4 * (last + 1)), "shard", "dim").sortWithinPartitions("shard", "dim", F.col("q").isNotNull())
    want = max(width, k + 1)
    copy = np.arange(k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            for i in range(b.num_rows):
                place = (b.column("shard")[i].as_py(), b.column("dim")[i].as_py())
                if b.column("graph")[i].is_valid:
                    at, dim, sizes = place, place[1], b.column("sizes")[i].as_py()
                    ids, copies, x, graph = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("ids", "<i8"), ("copies", "<i4"), ("vectors", "<f8"), ("graph", "<i4")))
                    x = x.reshape(-1, dim)
                    own_frame = frame(x)
                    inside = within(x, *own_frame)
                    starts = np.cumsum(copies) - copies
                    continue
                if place != at:  # no vectors of the queries' dimension are in this shard
                    continue
                own = b.column("q")[i].values
                qid = own.field("vec_id").to_numpy()
                q = own.field("v").flatten().to_numpy().reshape(-1, dim)
                found = search(inside, sizes, graph, within(q, *own_frame), want)
                d = distances(q[:, None, :], x[found])
                d[found < 0] = np.inf
                first = np.argsort(d, axis=1, kind="stable")
                d = np.take_along_axis(d, first, axis=1)
                some = (d <= d[:, min(k, d.shape[1] - 1)][:, None]).sum(axis=1).max()  # k + 1, and those as far as the last
                found, d = np.take_along_axis(found, first, axis=1)[:, :some], d[:, :some]
                own = (starts[found][:, :, None] + copy).reshape(len(q), -1)
                d = np.where((copy < copies[found][:, :, None]).reshape(len(q), -1), np.repeat(d, k + 1, axis=1), np.inf)
                near = ids[np.minimum(own, len(ids) - 1)]
                d[near == qid[:, None]] = np.inf
                order = np.lexsort((near, d), axis=1)[:, :k]
                d, near = np.take_along_axis(d, order, axis=1), np.take_along_axis(near, order, axis=1)
                ok = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, ok.sum(axis=1))), pa.array(near[ok]), pa.array(d[ok])], ["query_id", "vec_id", "score"])

    hits = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
