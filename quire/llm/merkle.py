"""Merkle manifest: sorted leaf runs, a node store in Parquet by level, proofs by merge scans over coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Levels that one pass over the store builds; a block has 2 ** BAND nodes at its lowest level. Rows of a batch.
BAND = 10
ROWS = 4096


def H(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """A row's leaf: the digest of its five values, each with its length in bytes; ``-`` for null."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(said, (doc_id, source, lang, n_chars, text))), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row is tampered with in the test of the proofs: by its number alone, null never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def ranked(items: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``items`` (g, ...) with pos, their place within g by ``order`` and then hash, and size, the rows of g; the largest size.

    Rows are sorted into runs that follow one another, and a run's places begin where g's rows in earlier runs end:
    a group of any size is dealt over as many runs as its rows fill. Runs and groups are counted in a small table, a row
    for each run of a group.
    """
    by = ["g", *order, "hash"]
    runs = items.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = keep(runs.withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), f"merkle-{name}")
    spans = runs.groupBy("g", "run").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(w.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = keep(spans.select("g", "run", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("size")), f"merkle-{name}-spans")
    placed = runs.join(spans, ["g", "run"]).withColumn("pos", F.col("at") + F.col("shift")).drop("run", "at", "shift")
    return placed, spans.agg(F.max("size")).first()[0] or 0


def _height(size: int) -> int:
    return (size - 1).bit_length()


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((g, block), rows) of rows that lie together; at most a block's rows are held."""
    now, held = None, []
    for b in batches:
        for row in zip(*[b.column(k).to_pylist() for k in names], strict=True):
            if row[:2] != now:
                if held:
                    yield now, held
                now, held = row[:2], []
            held.append(row)
    if held:
        yield now, held


def _table(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])


def _sent(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= ROWS:
            yield _table(out, types)
            out = []
    if out:
        yield _table(out, types)


def _band(nodes: DataFrame, first: int, band: int) -> DataFrame:
    """level, g, pos, size, hash of up to ``band`` levels above ``nodes`` (g, pos, size, hash), which are level ``first``.

    ``size`` is the number of a level's nodes in g. Nodes stream by in order, a block at a time.
    """
    types = [("level", pa.int32()), ("g", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("hash", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def above() -> Iterator[tuple]:
            for (g, block), rows in _blocks(batches, ["g", "block", "size", "hash"]):
                size, level = rows[0][2], [r[3] for r in rows]
                at = block << band
                for k in range(1, min(band, _height(size)) + 1):
                    level = [H("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
                    size, at = (size + 1) >> 1, at >> 1
                    yield from ((first + k, g, at + i, size, h) for i, h in enumerate(level))

        yield from _sent(above(), types)

    rows = nodes.where("size > 1").select("g", F.shiftright("pos", band).alias("block"), "pos", "size", "hash").repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return rows.select("g", "block", "size", "hash").mapInArrow(run, "level int, g string, pos long, size long, hash string")


def _proved(items: DataFrame, nodes: DataFrame, upper: DataFrame, first: int, band: int, extra: list[str], told: Callable[[str, list[str], str, str, tuple], tuple], schema: str, types: list[tuple[str, pa.DataType]]) -> DataFrame:
    """One row ``told(g, steps, hash, top, extras)`` per item (g, pos, size, hash, extra), which are level ``first``.

    A merge scan: the way from a block's top to the root (``upper``: g, block, steps, top), the block's inner nodes and its
    items stream by together in order of their coordinates. A step is ``L`` or ``R`` and the sibling on that side, or
    ``-`` where a node has none.
    """
    kinds = dict(items.dtypes)
    empty = [F.lit(None).cast(kinds[k]).alias(k) for k in extra]
    steps_none = F.lit(None).cast("array<string>")
    inner = nodes.where((F.col("level") > first) & (F.col("level") < first + band) & (F.col("size") > 1))
    block = F.expr(f"shiftright(pos, {band + first} - level)")
    rows = upper.select("g", "block", F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("size"), F.col("top").alias("hash"), "steps", *empty)
    rows = rows.unionByName(inner.select("g", block.alias("block"), "level", "pos", "size", "hash", steps_none.alias("steps"), *empty))
    rows = rows.unionByName(items.select("g", F.shiftright("pos", band).alias("block"), F.lit(first).alias("level"), "pos", "size", "hash", steps_none.alias("steps"), *extra))
    rows = rows.repartition("g", "block").sortWithinPartitions("g", "block", "level", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_() -> Iterator[tuple]:
            for (g, block), held in _blocks(batches, ["g", "block", "level", "pos", "size", "hash", "steps", *extra]):
                steps, top, levels, items = None, None, {}, []
                for row in held:
                    _, _, level, pos, size, h, up = row[:7]
                    if level < 0:
                        steps, top = up, h
                        continue
                    levels.setdefault(level - first, {})[pos] = h
                    if level == first:
                        items.append((pos, size, h, row[7:]))
                for pos, size, h, more in items:
                    way = []
                    for k in range(min(band, _height(size))):
                        beside = levels[k].get((pos >> k) ^ 1)
                        way.append("-" if beside is None else ("L" if pos >> k & 1 else "R") + beside)
                    yield told(g, pos, way + steps, h, top, more)

        yield from _sent(all_(), types)

    return rows.mapInArrow(run, schema)


def forest(items: DataFrame, most: int, band: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The node store over ranked ``items`` (g, pos, size, hash; the largest size): its tops (g, hash) and its bands' nodes."""
    tops, bands, level, first = items.where("size = 1").select("g", "hash"), [], items.select("g", "pos", "size", "hash"), 0
    while most > 1:
        made = keep(_band(level, first, band), f"merkle-{name}-{first}", "level")
        tops = tops.union(made.where("size = 1").select("g", "hash"))
        bands.append(made)
        first += band
        level = made.where((F.col("level") == first) & (F.col("size") > 1)).select("g", "pos", "size", "hash")
        most = -(-most >> band)
    return tops, bands


def _ways(items: DataFrame, bands: list[DataFrame], over: DataFrame, band: int, name: str) -> DataFrame:
    """g, block, steps, top: the way to the root from the top of each block of ``items``.

    ``over`` (g, steps, top) is the way from each group's own top. Bands are scanned from the highest down.
    """
    types = [("g", pa.string()), ("block", pa.int64()), ("steps", pa.list_(pa.string())), ("top", pa.string())]
    told = lambda g, pos, steps, h, top, more: (g, pos, steps, top)
    ways = over.select("g", F.lit(0).cast("long").alias("block"), "steps", "top")
    for k in range(len(bands) - 1, 0, -1):
        level = bands[k - 1].where((F.col("level") == k * band) & (F.col("size") > 1)).select("g", "pos", "size", "hash")
        lower = _proved(level, bands[k], ways, k * band, band, [], told, "g string, block long, steps array<string>, top string", types)
        done = ways.join(level.select("g").distinct(), "g", "left_anti")  # these groups' tops are not above this level
        ways = keep(lower.union(done), f"merkle-{name}-ways")
    return ways


def manifest(documents: DataFrame, band: int = BAND) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document (doc_id, source, lang, n_chars, text).

    The tree is the contract's: a row's leaf, a tree for each language by doc_id, and one over the languages' tops.
    A row that is tampered with gets the root that its changed leaf and the original siblings fold to. A null
    language is one of its own and comes first, a null doc_id comes first in its language; rows of one doc_id are
    ordered by their leaves, repeated rows each keep a leaf. Other columns are ignored; an empty table gives no rows.

    Texts do not leave the scan: what is sorted, shuffled and stored is digests. Each pass over the store builds ``band``
    levels in blocks of 2 ** ``band`` nodes, so a language with most of the rows is dealt over many tasks like any other.
    """
    kind = dict(documents.dtypes)["doc_id"]
    whole = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*whole[:3], F.col("n_chars").cast("decimal(20,0)") + 1, whole[4]]
    g = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang"))
    leaves, most = ranked(documents.select(g.alias("g"), "doc_id", leaf(*whole).alias("hash"), F.when(tampered(F.col("doc_id")), leaf(*more)).alias("altered")), ["doc_id"], "leaves")
    tops, bands = forest(leaves, most, band, "docs")
    roots, most = ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("lang"), "hash"), ["lang"], "tops")
    root, over = forest(roots, most, band, "root")
    over_ways = _ways(roots, over, root.select("g", F.array().cast("array<string>").alias("steps"), F.col("hash").alias("top")), band, "root")

    way_types = [("g", pa.string()), ("steps", pa.list_(pa.string())), ("top", pa.string())]
    subroots = lambda g, pos, steps, h, top, more: (more[0], [f"S{h}", *steps], top)  # noqa: E731  the language's top goes along as its first step
    own = _proved(roots, _nodes(over, roots), over_ways, 0, band, ["lang"], subroots, "g string, steps array<string>, top string", way_types)
    ways = _ways(leaves, bands, keep(own, "merkle-own"), band, "docs")

    def told(g: str, pos: int, steps: list[str], h: str, top: str, more: tuple) -> tuple:
        doc_id, altered = more
        subroot, proof, now = None, [], altered or h
        for s in steps:
            if s[0] == "S":
                subroot = s[1:]
            elif s == "-":
                now = H(now)
            else:
                proof.append(s[1:])
                now = H(s[1:] + now if s[0] == "L" else now + s[1:])
        return doc_id, h, subroot, top, H("".join(proof)), now, now == top

    types = [("doc_id", _arrow(kind)), *[(k, pa.string()) for k in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
    return _proved(leaves, _nodes(bands, leaves), ways, 0, band, ["doc_id", "altered"], told, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", types)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def _nodes(bands: list[DataFrame], items: DataFrame) -> DataFrame:
    """The lowest band's nodes, none where every group has one row."""
    return bands[0] if bands else items.select(F.lit(0).alias("level"), "g", "pos", "size", "hash").where("false")


#: The manifest in DuckDB: levels by recursion, proofs by joining each level's siblings.
ORACLE_SQL = """
with recursive crcs as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
  coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as n0, coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as n1, coalesce(strlen(text) || ':' || text, '-') as tail,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 and doc_id is not null as bad from documents, crcs),
leaves as (select *, sha256(head || n0 || tail) as leaf, case when bad then sha256(head || n1 || tail) end as altered from d),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves),
tree as (select lang, 0 as level, pos, leaf as h, count(*) over (partition by lang) as size from placed
  union all select lang, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(size) + 1) // 2 from tree where size > 1 group by lang, level, pos // 2),
subroots as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos from tree where size = 1),
upper_ as (select 0 as level, pos, subroot as h, count(*) over () as size from subroots
  union all select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(size) + 1) // 2 from upper_ where size > 1 group by level, pos // 2),
climb as (select doc_id, leaf, coalesce(altered, leaf) as now, p.lang, p.pos as node, 0 as level, 0 as tier, '' as proof, p.pos as own, size from placed p join tree t on t.level = 0 and t.pos = p.pos and t.lang is not distinct from p.lang
  union all select doc_id, leaf, sha256(case when s.h is null then now when node % 2 = 1 then s.h || now else now || s.h end), c.lang, node // 2, c.level + 1, 0, proof || coalesce(s.h, ''), own, (c.size + 1) // 2
  from climb c left join tree s on s.lang is not distinct from c.lang and s.level = c.level and s.pos = xor(c.node, 1) where c.size > 1),
risen as (select c.doc_id, c.leaf, c.now, s.subroot, s.pos as node, c.proof, c.own, c.lang, 0 as level, (select count(*) from subroots) as size from climb c join subroots s on s.lang is not distinct from c.lang where c.size = 1
  union all select doc_id, leaf, sha256(case when s.h is null then now when node % 2 = 1 then s.h || now else now || s.h end), subroot, node // 2, proof || coalesce(s.h, ''), own, lang, c.level + 1, (c.size + 1) // 2
  from risen c left join upper_ s on s.level = c.level and s.pos = xor(c.node, 1) where c.size > 1)
select doc_id, leaf, subroot, (select h from upper_ where size = 1) as root, sha256(proof) as proof_sha256, now as folded_root, now = (select h from upper_ where size = 1) as verified from risen where size = 1
"""
