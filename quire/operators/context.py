"""Ordered neighbours of a block, and how much of them a translator needs."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pack import Pack


def neighbours(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page, ord, kind, text, target) with previous_source, previous_target, next_source, section_heading.

    The next translatable block is looked for on the page only; the previous one and the last heading across pages.
    """
    ok = F.col("kind") != "pageFurniture"
    doc = Window.partitionBy("doc_id").orderBy("page", "ord")
    before, after = doc.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    last = lambda c, test: F.last(F.when(test, c), ignorenulls=True).over(before)
    return blocks.withColumns({
        "previous_source": last(F.col("text"), ok),
        "previous_target": last(F.col("target"), ok),
        "next_source": F.first(F.when(ok, F.col("text")), ignorenulls=True).over(after),
        "section_heading": last(F.coalesce("target", "text"), F.col("kind") == "heading"),
    })


def document_context(blocks: DataFrame) -> DataFrame:
    """doc_id, context: the first heading, else the first translatable block, of the first page that has any."""
    ok = blocks.where("kind <> 'pageFurniture'")
    rank = F.struct("page", (F.col("kind") != "heading").cast("int").alias("late"), "ord", F.coalesce("target", "text").alias("text"))
    return ok.groupBy("doc_id").agg(F.min(rank).alias("b")).select("doc_id", F.col("b.text").alias("context"))


#: Why a neighbour is given, in the order in which the reasons are told.
GIVEN = ("its predecessor's translation", "too short to say what it is about", "it points outside itself", "it goes on with the sentence before", "what the section says", "the line after it", "the heading above it")
#: What is told of a block that was translated a second time.
ALONE = "translated again by itself, since the first answer only copied the source"


def cues(text: Column, pack: Pack) -> tuple[Column, Column, Column, Column]:
    """What a text says of its need by itself: it is short, points outside itself, goes on with a sentence; it ends at a stop."""
    scrubbed = F.regexp_replace(text, "|".join(map(re.escape, pack.false_friends)), "\ufffd") if pack.false_friends else text
    any_ = lambda tests: reduce(or_, tests, F.lit(False))
    refers, begins = any_(F.contains(scrubbed, F.lit(w)) for w in pack.referring), any_(scrubbed.startswith(w) for w in pack.continuing)
    return F.char_length(text) < pack.self_contained, refers, begins, T.ends_at_stop(text, pack)


def need(text: Column, kind: Column, previous_source: Column, previous_target: Column, next_source: Column, heading: Column, pack: Pack) -> Column:
    """struct(previous_source, previous_target, following, heading, reasons): which neighbours a block needs, and why."""
    short, refers, begins, _ = cues(text, pack)
    continues = ~T.ends_at_stop(previous_source, pack) | begins
    able = kind != "pageFurniture"
    before, after, under = able & previous_source.isNotNull(), able & next_source.isNotNull(), able & heading.isNotNull()
    is_head = kind == "heading"
    tests = (able & previous_target.isNotNull(), before & short, before & refers, before & continues, after & is_head, after & ~is_head & short, under & (kind.isin("listItem", "tableRow") | short | refers))
    return F.struct(
        (before & (short | refers | continues)).alias("previous_source"), tests[0].alias("previous_target"), (after & (is_head | short)).alias("following"), tests[-1].alias("heading"),
        F.array_compact(F.array(*[F.when(t, why) for t, why in zip(tests, GIVEN, strict=True)])).alias("reasons"),
    )


def before(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page, ord, text) with context_before: the text of the block before on the page, null at its top."""
    return blocks.withColumn("context_before", F.lag("text").over(Window.partitionBy("doc_id", "page").orderBy("ord")))
