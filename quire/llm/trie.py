"""Prefix trie of conversations: paths by chained hashes, partial node tables merged by key, figures rolled up along paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Rebuilding: conversations to a family, and one more than the most turns that are taken from its first.
FAMILY, SHARED = 5, 9
#: Partial tables that one merge takes together, ids of consecutive numbers in one end list, and shares of a node's children.
FAN, IDS, SALTS = 64, 4096, 1024
#: Bytes of a node's key, and rows of a batch that leaves a task.
KEY, ROWS = 16, 8192
ROOT = bytes(KEY)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, n_bytes: what the trie needs of a row. The digest is of role and text, nulls empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.where("conv_id is not null")


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])


def paths(conversations: DataFrame) -> DataFrame:
    """run, conv_id, depth, key, parent, n_bytes, is_last: the rebuilt conversations' nodes, the root first.

    Families lie together, each with the conversation first that lends its turns; its first turns are all that a task
    holds. ``run`` is the number of the task, whose conversations follow those of the run before.
    """
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    rows = turns(conversations).withColumns({"family": family, "h": taken.cast("int"), "other": F.col("conv_id") != family})
    rows = rows.repartitionByRange("family").sortWithinPartitions("family", "other", "conv_id", "turn", "digest")
    types = [("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()), ("is_last", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        head: list[tuple] = []  # the first turns of the family's first conversation
        fam, conv, h, seen, depth, last = None, None, 0, 0, 0, None

        def step(digest: bytes, size: int) -> None:
            nonlocal depth, last
            if last:
                out.append((*last, False))
            depth += 1
            last = (conv, depth, hashlib.sha256(last[2] + digest).digest()[:KEY], last[2], size)

        for b in batches:
            for f, c, n, d, size in zip(*[b.column(k).to_pylist() for k in ("family", "conv_id", "h", "digest", "n_bytes")], strict=True):
                if f != fam:
                    fam, head = f, []
                if c != conv:
                    if last:
                        out.append((*last, True))
                    conv, h, seen, depth, last = c, n, 0, 0, (c, 0, ROOT, None, 0)
                    if c != f:
                        for x in head[:h]:
                            step(*x)
                if c == f and seen < SHARED - 1:
                    head.append((d, size))
                if c == f or seen >= h:
                    step(d, size)
                seen += 1
                if len(out) >= ROWS:
                    yield _batch(out, types)
                    out = []
        if last:
            out.append((*last, True))
        if out:
            yield _batch(out, types)

    made = rows.select("family", "conv_id", "h", "digest", "n_bytes").mapInArrow(run, "conv_id long, depth long, key binary, parent binary, n_bytes long, is_last boolean")
    return made.withColumn("run", F.spark_partition_id())


def merged(partial: DataFrame, by: list[str], sums: dict[str, Column], runs: int) -> DataFrame:
    """Partial tables (by, run, ...) merged into one: rounds of neighbouring runs, FAN at a time, then all that is left.

    ``sums`` name the columns and fold them; what folds once folds again. Each task first folds its own rows.
    """
    width = 1
    while runs > width * FAN:
        width *= FAN
        partial = partial.groupBy(*by, F.floor(F.col("run") / width).alias("run")).agg(*[f.alias(c) for c, f in sums.items()])
        partial = partial.withColumn("run", F.col("run") * width)
    return partial.groupBy(*by).agg(*[f.alias(c) for c, f in sums.items()])


def _ends(path: DataFrame, runs: int) -> DataFrame:
    """key, ends_sha256 of the nodes where conversations end.

    End lists are kept by blocks of consecutive ids, so a list has a bounded length however many conversations end at
    a node; the digest, which has to take its ids one after another, reads a node's blocks in order as they stream by.
    """
    own = path.where("is_last").select("key", F.floor(F.col("conv_id") / IDS).alias("block"), "run", F.array("conv_id").alias("ids"))
    lists = merged(own, ["key", "block"], {"ids": F.array_sort(F.flatten(F.collect_list("ids")))}, runs)
    lists = lists.select("key", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).repartition("key").sortWithinPartitions("key", "block")
    types = [("key", pa.binary()), ("ends_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for b in batches:
            for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if key == now:
                    digest.update(b",")
                else:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield _batch(out, types)
                out = []
        if digest:
            yield _batch([(now, digest.hexdigest())], types)

    return lists.mapInArrow(run, "key binary, ends_sha256 string")


def _parents(node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n_children) and (key, parent_conv_id). Children meet their parent in shares, so a hot parent is no hot key."""
    child = node.where("parent is not null").select("key", "parent", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("share"))
    shares = child.groupBy("parent", "share").agg(F.count(F.lit(1)).alias("n"))
    counted = shares.groupBy(F.col("parent").alias("key")).agg(F.sum("n").alias("n_children"))
    known = shares.join(node.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent").select("parent", "share", "parent_conv_id")
    return counted, child.join(known, ["parent", "share"]).select("key", "parent_conv_id")


def _rolled(path: DataFrame, node: DataFrame, runs: int) -> DataFrame:
    """key, n_leaves, saved_tokens: sums over subtrees, from the bottom up.

    A node belongs to its smallest member. Along each conversation's path, deepest node first, what belongs to the
    conversation is summed up, and every node above gets the sum so far; the partial sums of a node are then merged by
    its key. Each node is counted once, by its owner, in every subtree that it is in: all nodes above it are on that
    path. The work is in proportion to the rebuilt turns, however deep the trie is.
    """
    own = node.select(F.lit(-1).alias("run"), "conv_id", "depth", "key", F.lit(0).alias("place"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    steps = path.select("run", "conv_id", "depth", "key", F.lit(1).alias("place"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"))
    rows = own.union(steps).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("depth"), "place")
    types = [("key", pa.binary()), ("run", pa.int32()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, saved, leaves = None, 0, 0
        for b in batches:
            local: dict[tuple[bytes, int], list[int]] = {}
            for c, place, key, r, s, n in zip(*[b.column(k).to_pylist() for k in ("conv_id", "place", "key", "run", "saved", "leaf")], strict=True):
                if c != conv:
                    conv, saved, leaves = c, 0, 0
                if not place:
                    saved, leaves = saved + s, leaves + n
                elif saved or leaves:
                    at = local.setdefault((key, r), [0, 0])
                    at[0] += leaves
                    at[1] += saved
            if local:
                yield _batch([(k, r, *v) for (k, r), v in local.items()], types)

    risen = rows.select("conv_id", "place", "key", "run", "saved", "leaf").mapInArrow(run, "key binary, run int, n_leaves long, saved_tokens long")
    return merged(risen, ["key"], {"n_leaves": F.sum("n_leaves"), "saved_tokens": F.sum("saved_tokens")}, runs)


def nodes(conversations: DataFrame) -> DataFrame:
    """key, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    Conversations (conv_id, turn, role, text) are rebuilt as the contract says: their first turns come from the first
    conversation of their five, where they have so many. Null roles and texts are empty, null turns come first, rows
    of one turn (and repeated rows) are ordered by the digest of their role and text; rows without a conv_id belong to no
    conversation and are left out; other columns are ignored; an empty table has no nodes. Divisions of negative ids
    are cut toward zero, as in SQL. The rows of a conversation stream through one task in order, which its chained
    hashes need; a task holds a family's first eight turns.
    """
    path = keep(paths(conversations), "trie-paths")
    runs = (path.agg(F.max("run")).first()[0] or 0) + 1
    counted = merged(path.select("key", "parent", "depth", "n_bytes", "run", "conv_id", F.lit(1).cast("long").alias("n_convs")), ["key", "parent", "depth", "n_bytes"], {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")}, runs)
    node = keep(counted, "trie-nodes")
    children, parents = _parents(node)
    node = node.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    node = keep(node.join(_ends(path, runs), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))), "trie-counted")
    return node.join(_rolled(path, node, runs), "key").join(parents, "key", "left").drop("n_bytes")


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's columns of :func:`nodes`."""
    return nodes(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The trie in DuckDB: paths as digests of whole prefixes, subtrees by the path of each node's smallest member.
ORACLE_SQL = """
with crcs as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
r as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(encode(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) as n, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select distinct conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 as h from r, crcs),
turned as (select c.conv_id, r.n, role, text from c join r on r.conv_id = c.conv_id - c.conv_id % 5 where r.n <= h union all select c.conv_id, r.n, role, text from c join r using (conv_id) where r.n > h),
numbered as (select conv_id, row_number() over (partition by conv_id order by n) as depth, strlen(text) as size, strlen(role) || ':' || strlen(text) || ':' || role || text as said from turned),
p as (select conv_id, 0 as depth, '' as k, null as up, 0 as size from c union all
  select conv_id, depth, sha256(string_agg(said, '' order by depth) over w) as k, case when depth = 1 then '' else sha256(string_agg(said, '' order by depth) over (w rows between unbounded preceding and 1 preceding)) end, size from numbered window w as (partition by conv_id order by depth)),
n as (select k, depth, any_value(up) as up, any_value(size) as size, count(*) as n_convs, min(conv_id) as conv_id from p group by k, depth),
kids as (select up as k, count(*) as n_children from n where up is not null group by up),
lasts as (select k, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, arg_max(k, depth) as k from p group by conv_id) group by k),
subs as (select p.k, sum(case when n_children is null then 1 else 0 end) as n_leaves, sum((n.n_convs - 1) * n.size) as saved_tokens from n left join kids using (k) join p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.k)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from n left join n u on u.k = n.up left join kids on kids.k = n.k left join lasts on lasts.k = n.k join subs on subs.k = n.k
"""
