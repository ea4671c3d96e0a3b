"""Boxes among the other boxes of their page."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Mapping
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def neighbours(blocks: DataFrame) -> DataFrame:
    """doc_id, page, ord, shares_rows, shares_columns, right_limit, floor_limit of blocks (doc_id, page, ord, x, y, w, h).

    right_limit is the left edge of the nearest block to the right in the same rows (1 for none), floor_limit the top
    of the nearest block below in the same columns. Blocks meet the others of their page as an array, page by page.
    """
    boxes = F.collect_list(F.struct("ord", "x", "y", "w", "h")).over(Window.partitionBy("doc_id", "page"))
    all_ = blocks.select("doc_id", "page", "ord", "x", "y", "w", "h", boxes.alias("boxes"))
    rows = lambda b: (b["ord"] != F.col("ord")) & (b["y"] < F.col("y") + F.col("h")) & (b["y"] + b["h"] > F.col("y"))
    cols = lambda b: (b["ord"] != F.col("ord")) & (b["x"] < F.col("x") + F.col("w")) & (b["x"] + b["w"] > F.col("x"))
    right = F.array_min(F.transform(F.filter("boxes", lambda b: rows(b) & (b["x"] >= F.col("x") + F.col("w"))), lambda b: b["x"]))
    floor = F.array_min(F.transform(F.filter("boxes", lambda b: cols(b) & (b["y"] >= F.col("y") + F.col("h"))), lambda b: b["y"]))
    return all_.select("doc_id", "page", "ord", F.exists("boxes", rows).alias("shares_rows"), F.exists("boxes", cols).alias("shares_columns"), F.coalesce(right, F.lit(1.0)).alias("right_limit"), F.coalesce(floor, F.lit(1.0)).alias("floor_limit"))


def type_runs(blocks: DataFrame, same: float = 1.25) -> DataFrame:
    """doc_id, page, run, n, size: sizes of a page's blocks (doc_id, page, ord, size), sorted and cut where the next is
    over ``same`` times the last; the size of a run is its upper median."""
    w = Window.partitionBy("doc_id", "page").orderBy("size", "ord")
    starts = F.when(F.col("size") <= F.lag("size").over(w) * same, 0).otherwise(1)
    marked = blocks.withColumn("starts", starts)
    return marked.withColumn("run", F.sum("starts").over(w)).groupBy("doc_id", "page", "run").agg(F.count("*").alias("n"), T.upper_median(F.collect_list("size")).alias("size"))


def page_measure(blocks: DataFrame) -> DataFrame:
    """doc_id, page, left, right: how far a page's blocks reach."""
    return blocks.groupBy("doc_id", "page").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"))


#: lines' distance and height in sizes of their type, the least size, and how much larger than the body's
#: median a block that is no heading may be; a new run of sizes begins over SAME times the last.
LEADING, LINE_BOX, LEAST_SIZE, LARGEST_BODY, SAME = 1.45, 1.12, 6.5, 1.4, 1.25
#: The gap to a neighbour in heights, and how near to the middle and how narrow a centred block is.
CLEAR, OFF_CENTRE, CENTRED_WIDTH = 0.35, 0.06, 0.8
_RECT = ["x0", "y0", "x1", "y1"]


def rects(blocks: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """``blocks`` (x, y, w, h: shares from the top left) with x0, y0, x1, y1 in points from the bottom left."""
    x0, y0 = F.col("x") * width, (1 - (F.col("y") + F.col("h"))) * height
    return blocks.withColumns({"x0": x0, "y0": y0, "x1": x0 + F.col("w") * width, "y1": y0 + F.col("h") * height})


def _among(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page, ord, kind, rects) with others: the rects of their page, an array that a page bounds."""
    page = Window.partitionBy("doc_id", "page")
    return blocks.withColumns({
        "others": F.collect_list(F.struct("ord", "kind", *_RECT)).over(page), "left": F.min("x0").over(page), "right": F.max("x1").over(page),
    })


def _rows_shared(b: Column) -> Column:
    return (b["ord"] != F.col("ord")) & (b["y0"] < F.col("y1")) & (b["y1"] > F.col("y0"))


def free_space(blocks: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """doc_id, page, ord, shares_lines, centred, space_x, space_w, room_below of blocks (doc_id, page, ord, kind, x, y, w, h).

    The widest rectangle of a block's height that meets no neighbour: those in its rows, and beside it all but page
    furniture, stop it at a gap of 0.35 heights; a centred block grows alike on both sides. room_below is the top of
    the highest block under it in the columns of that space (0: the page's edge), no higher than its own bottom.
    """
    b = _among(rects(blocks, width, height))
    tall, gap = F.col("y1") - F.col("y0"), (F.col("y1") - F.col("y0")) * CLEAR
    apart = lambda o: (o["ord"] != F.col("ord")) & ~_rows_shared(o) & (o["kind"] != "pageFurniture")
    stops_right = F.filter("others", lambda o: (_rows_shared(o) & (o["x0"] > F.col("x0"))) | (apart(o) & (o["x0"] >= F.col("x1"))))
    stops_left = F.filter("others", lambda o: (_rows_shared(o) & (o["x1"] < F.col("x1"))) | (apart(o) & (o["x1"] <= F.col("x0"))))
    right = F.least("right", F.array_min(F.transform(stops_right, lambda o: o["x0"] - gap)))
    left = F.greatest("left", F.array_max(F.transform(stops_left, lambda o: o["x1"] + gap)))
    b = b.withColumns({"to": F.greatest(right, F.col("x1")), "fro": F.least(left, F.col("x0")), "shares_lines": F.exists("others", _rows_shared)})
    middle, wide = (F.col("x0") + F.col("x1")) / 2, F.col("right") - F.col("left")
    b = b.withColumn("centred", ~F.col("shares_lines") & (wide > 0) & (F.abs(middle - (F.col("left") + F.col("right")) / 2) < wide * OFF_CENTRE) & (F.col("x1") - F.col("x0") < wide * CENTRED_WIDTH))
    half = F.least(middle - F.col("fro"), F.col("to") - middle)
    b = b.withColumns({"space_x": F.when(F.col("centred"), middle - half).otherwise(F.col("x0")), "space_w": F.when(F.col("centred"), half * 2).otherwise(F.col("to") - F.col("x0"))})
    under = F.filter("others", lambda o: (o["ord"] != F.col("ord")) & (o["x0"] < F.col("space_x") + F.col("space_w")) & (o["x1"] > F.col("space_x")) & (o["y1"] <= F.col("y0") + tall / 2))
    floor = F.greatest(F.lit(0.0), F.array_max(F.transform(under, lambda o: o["y1"])))
    return b.select("doc_id", "page", "ord", "shares_lines", "centred", "space_x", "space_w", F.least(floor, F.col("y0")).alias("room_below"))


def type_sizes(blocks: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """doc_id, page, ord, heading, size: the type that each block (.., kind, n_lines, x, y, w, h) is set in.

    A block's own size follows from its height and lines. Headings (those that share no line) and the rest are each
    sorted and cut into runs where a size is over 1.25 times the last; a run has its upper median. What is no heading
    stays within 1.4 times the body's median; nothing is under 6.5.
    """
    b = _among(rects(blocks, width, height))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    own = (F.col("y1") - F.col("y0")) / ((lines - 1) * LEADING + LINE_BOX)
    b = b.select("doc_id", "page", "ord", own.alias("own"), ((F.col("kind") == "heading") & ~F.exists("others", _rows_shared)).alias("heading"))
    page = Window.partitionBy("doc_id", "page")
    of = lambda c: T.upper_median(F.collect_list(c).over(page))
    b = b.withColumn("body", F.coalesce(of(F.when(~F.col("heading"), F.col("own"))), of(F.col("own")), F.lit(LEAST_SIZE)))
    group = Window.partitionBy("doc_id", "page", "heading").orderBy("own", "ord")
    b = b.withColumn("starts", F.when(F.col("own") <= F.lag("own").over(group) * SAME, 0).otherwise(1)).withColumn("run", F.sum("starts").over(group))
    size = T.upper_median(F.collect_list("own").over(Window.partitionBy("doc_id", "page", "heading", "run")))
    capped = F.when(F.col("heading"), size).otherwise(F.least(size, F.col("body") * LARGEST_BODY))
    return b.select("doc_id", "page", "ord", "heading", F.greatest(F.lit(LEAST_SIZE), capped).alias("size"))


def drawable(source: Column, target: Column, x: Column, y: Column, w: Column, h: Column, width: float = 1.0, height: float = 1.0) -> Column:
    """Whether a block is drawn at all: its text is neither blank nor as printed, and it has a box over 4 points each way."""
    text = T.trimmed(F.coalesce(target, F.lit("")))
    whole = (x == 0) & (y == 0) & (w == 1) & (h == 1)
    return (text != "") & (text != source) & ~whole & (w * width > 4) & (h * height > 4)


# --- setting the type ------------------------------------------------------------------------------------------------

#: The largest size, and how a size that is too large is reduced: by a share of it, at least by a step.
LARGEST, SHRINK, STEP = 72.0, 0.08, 0.5
#: A stand-in font: the height of a line in sizes, and widths of characters in eighths of a size, the first that lists
#: it; Latin letters in capitals and characters from WIDE on have their own, all others are half a size wide.
LINE = 1.125
WIDTHS = {" .,;:!|'ijl": 2, "mwMW": 7}
CAPITAL, OTHER, WIDE, WIDE_FROM = 5, 4, 8, 0x2E80


def char_width(c: str, widths: Mapping[str, int] = WIDTHS) -> int:
    """Eighths of a size that a character takes."""
    return next((n for cs, n in widths.items() if c in cs), WIDE if ord(c) >= WIDE_FROM else CAPITAL if "A" <= c <= "Z" else OTHER)


class _Widths(dict):
    """Characters' widths as they are met."""

    def __init__(self, widths: Mapping[str, int]):
        self.given = widths

    def __missing__(self, c: str) -> int:
        self[c] = char_width(c, self.given)
        return self[c]


class Setter:
    """A text's words and prefix sums of its characters' widths: lines of any width are found by search."""

    def __init__(self, text: str, widths: Mapping[str, int] = WIDTHS):
        held = widths if isinstance(widths, _Widths) else _Widths(widths)
        self.at = [*accumulate(map(held.__getitem__, text), initial=0)]
        # where a line may end: before each run of blanks; and where the next one then begins: after it
        blanks = [m.span() for m in re.finditer(" +", text)]
        self.ends, self.begins = [b for b, _ in blanks] + [len(text)], [e for _, e in blanks] + [len(text)]

    def lines(self, width: float, most: float = math.inf) -> int:
        """Lines of a text set in ``width`` eighths of a size. Blanks at a break vanish; a longer word is broken anywhere,
        with one character a line at least. Those after the first over ``most`` are not counted."""
        at, n, count, i = self.at, self.ends[-1], 0, 0
        while i < n and count <= most:
            count += 1
            reach = bisect_right(at, at[i] + width) - 1  # the last place that the line may reach
            if reach >= n:
                break
            k = bisect_right(self.ends, reach) - 1
            if k >= 0 and self.ends[k] > i:
                i = self.begins[k]
            else:  # a word wider than the line; where it ends with the line, so do the blanks after it
                i = max(reach, i + 1)
                k = bisect_right(self.ends, i) - 1
                i = self.begins[k] if k >= 0 and self.ends[k] == i else i
        return max(count, 1)


def fitted(setter: Setter, size: float, width: float, available: float, line: float = LINE) -> tuple[float, int]:
    """The largest size from ``size`` down, by steps of 8 % (half a point at least), at which the lines fit; and their
    number. The least size is taken as it is.

    A smaller size has no more lines (of a text that does not begin with blanks), so the first that fits is found by
    halving, and no more lines are counted than fit: all of them at the least size alone.
    """
    sizes = [max(LEAST_SIZE, min(LARGEST, size))]
    while sizes[-1] > LEAST_SIZE:
        sizes.append(max(LEAST_SIZE, sizes[-1] - max(STEP, sizes[-1] * SHRINK)))

    def lines(k: int) -> int | None:
        """Lines at a size, if they fit."""
        n = setter.lines(width * 8 / sizes[k], available / (sizes[k] * line) + 1)
        return n if n * sizes[k] * line <= available else None

    low, high, found = 0, len(sizes) - 1, None
    while low < high:
        at = (low + high) // 2 if low else 0  # most texts fit as they are
        n = lines(at)
        low, high, found = (low, at, n) if n is not None else (at + 1, high, found)
    return sizes[low], setter.lines(width * 8 / sizes[low]) if found is None or low == len(sizes) - 1 else found


def refit(text: Column, size: Column, width: Column, height: Column, room: Column, widths: Mapping[str, int] = WIDTHS) -> Column:
    """struct(size, n_lines): how a text is set in a space ``width`` wide, ``height`` high, with ``room`` free below it.

    ``size`` is that of its run (see :func:`type_sizes`). White space is one blank; null and blank texts are one line of
    their run's size; sizes stay from 6.5 to 72.
    """

    @F.pandas_udf("struct<size:double,n_lines:int>")
    def run(t: pd.Series, s: pd.Series, w: pd.Series, a: pd.Series) -> pd.DataFrame:
        held = _Widths(widths)
        return pd.DataFrame([fitted(Setter(" ".join((x or "").split()), held), *v) for x, *v in zip(t, s, w, a, strict=True)], columns=["size", "n_lines"])

    return run(text, size.cast("double"), width.cast("double"), (height + F.greatest(F.lit(0.0), room)).cast("double"))
