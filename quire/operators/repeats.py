"""Texts that repeat an earlier one of their group: a segment index for edit distance, and the keep-first set by rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import drop, keep
from .reconcile import REPEATS, text_similarity

#: Characters of a segment at most. Fixed by the share of edits that a repeat may have: under a tenth of the longer text,
#: so a text of n characters has at most (n - 1) // 9 edits to any repeat of at least its length, and one segment more.
SEGMENT = 9
#: Different texts of a group that are gone through in one task.
SMALL = 256


def _segments(n: Column) -> Column:
    return F.ceil(n / SEGMENT).cast("int")


def _edits(n: Column) -> Column:
    """Most edits between a text of n characters and a shorter one that it repeats."""
    return F.floor((n - 1) / 10).cast("int")


def _indexed(t: DataFrame) -> DataFrame:
    """A row per segment of a text: its hash (gram) and place (at). The segments are of even lengths and cover the text."""
    count, each = _segments(F.col("n")), F.floor(F.col("n") / _segments(F.col("n"))).cast("int")
    short = count - F.col("n") % count  # so many segments have the lesser length
    begin = lambda i: i * each + F.greatest(F.lit(0), i - short)
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(begin(i).alias("at"), F.xxhash64(F.substring(F.col("head"), begin(i) + 1, begin(i + 1) - begin(i))).alias("gram")))
    return t.where("n >= 10").withColumn("part", F.explode(parts))


def _probed(t: DataFrame) -> DataFrame:
    """A row per substring of a text that may be a segment of a text no longer than it."""
    n = F.col("n")
    partners = F.sequence(n - _edits(n), n)
    each = lambda k: F.floor(k / _segments(k)).cast("int")
    sizes = F.array_distinct(F.flatten(F.transform(partners, lambda k: F.when(k % _segments(k) == 0, F.array(each(k))).otherwise(F.array(each(k), each(k) + 1)))))
    parts = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(0), n - s), lambda i: F.struct(i.alias("at"), F.xxhash64(F.substring(F.col("head"), i + 1, s)).alias("gram")))))
    return t.where("n >= 11").withColumn("part", F.explode(parts))


def similar_pairs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: pairs of different texts (keys, id, head, n: characters of head) that are over 0.9 similar, each pair once.

    Two such texts differ in fewer places than the shorter one has segments, so one of its segments stands in the longer
    one as it is, and nearly at its place: pairs meet by equality of key and segment, and only pairs whose lengths and
    places fit are compared, by a distance that stops at the most edits allowed. No pair is lost.
    """
    side = lambda t, p: t.select(*keys, F.col("part.gram").alias("gram"), F.col("id").alias(p), F.col("n").alias(f"n_{p}"), F.col("part.at").alias(f"at_{p}"))
    short, long = side(_indexed(texts), "x"), side(_probed(texts), "y")
    met = short.join(long, [*keys, "gram"]).where((F.col("n_x") < F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y")))
    most = _edits(F.col("n_y"))
    met = met.where((F.col("n_y") - F.col("n_x") <= most) & (F.abs(F.col("at_x") - F.col("at_y")) <= most)).select(*keys, "x", "y").distinct()
    of = lambda p: texts.select(*keys, F.col("id").alias(p), F.col("head").alias(f"head_{p}"), F.col("n").alias(f"n_{p}"))
    both = met.join(of("x"), [*keys, "x"]).join(of("y"), [*keys, "y"])
    return both.where(F.expr("levenshtein(head_x, head_y, cast((n_y - 1) div 10 as int)) >= 0")).select(*keys, F.col("x").alias("a"), F.col("y").alias("b"))


def _kept_of_large(firsts: DataFrame, by: list[str]) -> DataFrame:
    """``firsts`` (by, id, place, text, head, n) that stay, by the segment index and rounds over its pairs."""
    place = lambda p: firsts.select(*by, F.col("id").alias(p), F.struct("place", "id").alias(f"at_{p}"))
    pairs = similar_pairs(firsts.select(*by, "id", "head", "n"), by).join(place("a"), [*by, "a"]).join(place("b"), [*by, "b"])
    early = F.col("at_a") < F.col("at_b")
    edges = keep(pairs.select(*by, F.when(early, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("b")), "repeats-pairs")
    gone = None
    while not edges.isEmpty():
        heads = edges.select(*by, "a").distinct().join(edges.select(*by, F.col("b").alias("a")).distinct(), [*by, "a"], "left_anti")
        out = keep(edges.join(heads, [*by, "a"], "left_semi").select(*by, F.col("b").alias("id")).distinct(), "repeats-gone")
        gone = out if gone is None else gone.union(out)
        left = edges.join(out.withColumnRenamed("id", "b"), [*by, "b"], "left_anti").join(out.withColumnRenamed("id", "a"), [*by, "a"], "left_anti")
        before, edges = edges, keep(left.select(*by, "a", "b"), "repeats-pairs")
        drop(before)
    return firsts if gone is None else firsts.join(gone, [*by, "id"], "left_anti")


#: Characters of the pieces that tell most texts apart before their distance is worked out.
PIECE = 5


def _may_repeat(a: str, b: str) -> bool:
    """False only for texts that are not over 0.9 similar: of one's pieces each edit changes one at most, and the others
    stand in the other text, moved by no more than the edits allowed."""
    if len(a) > len(b):
        a, b = b, a
    edits = max(len(b) - 1, 0) // 10
    if len(b) - len(a) > edits:
        return False
    missing = 0
    for i in range(0, len(a) - PIECE + 1, PIECE):
        if b.find(a[i : i + PIECE], max(0, i - edits), i + PIECE + edits) < 0:
            missing += 1
            if missing > edits:
                return False
    return True


def repeats_one(heads: list[str], x: str) -> bool:
    """Whether a text is over 0.9 similar to one of some."""
    return any(_may_repeat(k, x) and text_similarity(k, x) > REPEATS for k in heads)


def kept_first(texts: DataFrame, keys: list[str], order: str = "ord", small: int = SMALL) -> DataFrame:
    """keys, order, text of the texts that a group keeps: each in its order, unless one kept before is over 0.9 similar.

    Texts (keys, order, text) are compared by their first 2000 characters. Of texts that are equal there the first is
    left before anything else, so copies cost one text; texts of one place follow each other by digest, null texts are
    empty, null keys are keys of their own, other columns are left out. An empty table gives none.

    A group of up to ``small`` different texts, such as a page, is gone through in its task. Larger ones are never
    brought together: their similar pairs come from :func:`similar_pairs`, and which texts stay is settled by rounds over
    the pairs: what no undecided text comes before is kept, what it is similar to goes, with all pairs of those; until no
    pair is left. Both ways keep the same texts.
    """
    null = [f"__{k}" for k in keys]  # a null key and what stands for it, so that joins by equality find it
    kinds = dict(texts.dtypes)
    held = [F.coalesce(k, F.lit("" if kinds[k] == "string" else 0).cast(kinds[k])).alias(k) for k in keys] + [F.col(k).isNull().alias(n) for k, n in zip(keys, null, strict=True)]
    by = [*keys, *null]
    head = F.left("text", F.lit(T.COMPARED))  # not shuffled beside the text
    rows = texts.select(*held, F.col(order).alias("place"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.md5(head))
    firsts = rows.groupBy(*by, "id").agg(F.min(F.struct("place", "text")).alias("first")).select(*by, "id", "first.place", "first.text")
    firsts = keep(firsts, "repeats-texts")
    # kept, so that a join with few of them is planned as a broadcast and texts are shuffled once less
    large = keep(firsts.groupBy(*by).count().where(F.col("count") > small).select(*by), "repeats-large-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups one after the other, by the texts that the present one keeps."""
        now, kept = None, []
        for t in batches:
            taken = []
            keyed = zip(*[t.column(k).to_pylist() for k in by], strict=True)
            for i, (key, x) in enumerate(zip(keyed, (x[: T.COMPARED] for x in t.column("text").to_pylist()), strict=True)):
                if key != now and (now is None or any(p != q and (p == p or q == q) for p, q in zip(key, now, strict=True))):
                    now, kept = key, []
                if not repeats_one(kept, x):
                    kept.append(x)
                    taken.append(i)
            yield t.select([*by, "place", "text"]).take(pa.array(taken, pa.int64()))

    schema = firsts.select(*by, "place", "text").schema
    # dealt by a hash of the keys: by the keys themselves the join's own shuffle would serve, which is read by file, groups
    # apart, where the join becomes a broadcast as it runs
    small_ = firsts.join(large, by, "left_anti").repartition(F.xxhash64(*by)).sortWithinPartitions(*by, F.asc_nulls_last("place"), "id")
    own = small_.mapInArrow(run, schema)
    if not large.isEmpty():
        big = keep(firsts.join(large, by, "left_semi").withColumn("head", head).withColumn("n", F.char_length("head")), "repeats-large")
        own = own.union(_kept_of_large(big, by).select(*by, "place", "text"))
    return own.select(*[F.when(~F.col(n), F.col(k)).alias(k) for k, n in zip(keys, null, strict=True)], F.col("place").alias(order), "text")
