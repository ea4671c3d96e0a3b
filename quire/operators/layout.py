"""Lines to blocks: gutters, reading order, grouping, classification, sentences."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pack import Pack
from ..sources.shared import parts

PAGE = ["doc_id", "page"]
#: X bins, empty bins of a gutter, bins that lines span, lines of a page and of each side.
BINS, INTERIOR, SPAN, LEAST_LINES, LEAST_SIDE = 100, 4, 20, 6, 3
#: How far apart lines of a block are, in heights, how much they overlap, and how their heights compare.
FARTHEST, NEAREST, OVERLAP, SHORTER, TALLER = 1.25, -0.6, 0.4, 0.7, 1.45
#: furniture's length and edges, a heading's height over the median, its length and lines.
FURNITURE, BOTTOM, TOP, HEADING, HEADING_LENGTH, HEADING_LINES = 24, 0.93, 0.05, 1.3, 60, 2


def gutters(lines: DataFrame) -> DataFrame:
    """doc_id, page, left, right, gutter_x: the widest empty run of x bins inside a page's lines, the first of equals.

    Pages need six lines over more than twenty bins, and three lines on each side of a run of four bins at least.
    """
    first = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col("x") * BINS))).cast("int")
    last = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("x") + F.col("w")) * BINS))).cast("int")
    placed = lines.select(*PAGE, "x", "w", first.alias("b0"), F.greatest(first, last).alias("b1"))
    pages = placed.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("b0").alias("lo"), F.max("b1").alias("hi"), F.sort_array(F.collect_set(F.struct("b0", "b1"))).alias("spans"), F.collect_list(F.struct("x", "w")).alias("at")).where(f"n >= {LEAST_LINES} and hi - lo > {SPAN}")
    # bins covered so far while walking the spans by their start: a gap opens where the next span begins beyond it
    walk = F.aggregate("spans", F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<n:int,lo:int,hi:int>>").alias("gaps")), lambda acc, s: F.struct(F.greatest(acc["end"], s["b1"]).alias("end"), F.when((acc["end"] >= 0) & (s["b0"] - acc["end"] - 1 >= INTERIOR), F.concat(acc["gaps"], F.array(F.struct((s["b0"] - acc["end"] - 1).cast("int").alias("n"), (acc["end"] + 1).cast("int").alias("lo"), (s["b0"] - 1).cast("int").alias("hi"))))).otherwise(acc["gaps"]).alias("gaps")))
    gaps = pages.select(*PAGE, "at", F.explode(walk["gaps"]).alias("g"))
    middle = (F.col("g.lo") + F.col("g.hi") + 1) / (2.0 * BINS)
    sides = gaps.select(*PAGE, "g", F.round(middle, 6).alias("gutter_x"), F.size(F.filter("at", lambda a: a["x"] + a["w"] <= middle)).alias("left"), F.size(F.filter("at", lambda a: a["x"] >= middle)).alias("right")).where(f"left >= {LEAST_SIDE} and right >= {LEAST_SIDE}")
    best = sides.groupBy(*PAGE).agg(F.max(F.struct(F.col("g.n").alias("n"), (-F.col("g.lo")).alias("first"), "left", "right", "gutter_x")).alias("b"))
    return best.select(*PAGE, "b.left", "b.right", "b.gutter_x")


def reading_order(lines: DataFrame) -> DataFrame:
    """``lines`` with ``ord``: by y on pages without a gutter; else band by band, spanning lines, left, then right."""
    w = Window.partitionBy(*PAGE)
    at = lines.join(gutters(lines).select(*PAGE, "gutter_x"), PAGE, "left")
    side = F.when(F.col("gutter_x").isNull(), 0).when(F.col("x") + F.col("w") <= F.col("gutter_x"), 1).when(F.col("x") >= F.col("gutter_x"), 2).otherwise(0)
    sided = at.withColumn("side", side)
    crossing = F.when(F.col("gutter_x").isNotNull() & (F.col("side") == 0), 1).otherwise(0)
    banded = sided.withColumn("band", F.sum(crossing).over(w.orderBy("y", "line_no")))
    return banded.withColumn("ord", F.row_number().over(w.orderBy("band", "side", "y", "line_no")) - 1).select(*lines.columns, "ord")


def grouped(lines: DataFrame) -> DataFrame:
    """``lines`` (with ord, x, y, w, h) with ``block``: a line joins the one before it if gap, overlap and height agree."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    px, py, pw, ph = (F.lag(c).over(w) for c in ("x", "y", "w", "h"))
    gap = F.col("y") - (py + ph)
    tall = F.greatest(ph, F.col("h"))
    overlap = (F.least(F.col("x") + F.col("w"), px + pw) - F.greatest(F.col("x"), px)) / F.least(F.col("w"), pw)
    joins = (F.col("h") > 0) & (ph > 0) & (gap <= tall * FARTHEST) & (gap >= tall * NEAREST) & (overlap >= OVERLAP) & (ph / F.col("h")).between(SHORTER, TALLER)
    marked = lines.withColumn("starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("block", F.sum("starts").over(w) - 1).drop("starts")


def classify(text: Column, lines: Column, y: Column, height: Column, median: Column, pack: Pack) -> Column:
    """furniture, list item, heading or paragraph; the first rule that holds."""
    trimmed = T.trimmed(text)
    stops = re.escape(pack.stops)
    return (
        F.when((F.char_length(trimmed) <= FURNITURE) & (lines == 1) & ((y + height > BOTTOM) | (y < TOP)), "pageFurniture")
        .when(T.list_item(trimmed), "listItem")
        .when((lines <= HEADING_LINES) & ~trimmed.rlike(f"[{stops}]$") & (height / lines > median * HEADING) & (F.char_length(trimmed) <= HEADING_LENGTH), "heading")
        .otherwise("paragraph")
    )


def joined(lines: Column, pack: Pack) -> Column:
    """Wrapped lines as one string; a blank between them if the script is spaced or both sides are ASCII letters or digits."""
    if pack.spaced:
        return F.array_join(lines, " ")
    return F.aggregate(lines, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.concat(F.right(acc, F.lit(1)), F.left(x, F.lit(1))).rlike("^[A-Za-z0-9]{2}$"), F.concat(acc, F.lit(" "), x)).otherwise(F.concat(acc, x)))


def blocks(lines: DataFrame, pack: Pack) -> DataFrame:
    """Lines in reading order, grouped: doc_id, page, block, n_lines, text, kind, x, y, w, h, confidence."""
    kept = lines.where(~T.blank(F.col("text")))
    median = kept.groupBy(*PAGE).agg(T.upper_median(F.collect_list("h")).alias("median"))
    g = grouped(reading_order(kept)).groupBy(*PAGE, "block").agg(
        F.count("*").cast("int").alias("n_lines"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("lines"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.avg("confidence").alias("confidence"),
    )
    g = g.join(median, PAGE).withColumn("text", T.normalized(joined(F.col("lines"), pack), pack))
    return g.withColumn("kind", classify(F.col("text"), F.col("n_lines"), F.col("y"), F.col("h"), F.col("median"), pack)).select(*PAGE, "block", "n_lines", "text", "kind", "x", "y", "w", "h", "confidence")


def runs(lines: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, page, block, kind, confidence, lines (ord, text, x, y, w, h): each block's lines, not yet cut.

    The median height of a page's lines is 0.02 where it has none; the confidence is the lines' mean.
    """
    kept = lines.where(~T.blank(F.col("text")))
    median = F.coalesce(T.upper_median(F.collect_list("h").over(Window.partitionBy(*PAGE))), F.lit(0.02))
    g = grouped(reading_order(kept.withColumn("median", median))).groupBy(*PAGE, "block").agg(
        F.sort_array(F.collect_list(F.struct("ord", "text", "x", "y", "w", "h"))).alias("lines"), F.avg("confidence").alias("confidence"), F.first("median").alias("median"),
        F.min("y").alias("y"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    )
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "")
    return g.select(*PAGE, "block", classify(text, F.size("lines"), F.col("y"), F.col("h"), F.col("median"), pack).alias("kind"), "confidence", "lines")


def joined_with_spans(texts: list[str], pack: Pack) -> tuple[str, list[tuple[int, int]]]:
    """Wrapped lines as one string, and where each line stands in it."""
    out, spans = "", []
    for t in texts:
        if out and (pack.spaced or re.fullmatch("[A-Za-z0-9]{2}", out[-1:] + t[:1])):
            out += " "
        spans.append((len(out), len(out) + len(t)))
        out += t
    return out, spans


def box_over(start: int, end: int, spans: list[tuple[int, int]], boxes: list[tuple]) -> tuple | None:
    """The box (x, y, w, h) around [start, end): whole lines, and of a line cut in two its share by characters."""
    found = None
    for (a, b), (x, y, w, h) in zip(spans, boxes, strict=True):
        lo, hi = max(a, start), min(b, end)
        if lo >= hi:
            continue
        if (lo, hi) != (a, b):
            x, w = x + w * ((lo - a) / (b - a)), w * ((hi - lo) / (b - a))
        if found is None:
            found = (x, y, x + w, y + h)
        else:
            found = (min(found[0], x), min(found[1], y), max(found[2], x + w), max(found[3], y + h))
    return found and (found[0], found[1], found[2] - found[0], found[3] - found[1])


def cut_run(lines: list[dict], pack: Pack) -> list[tuple[str, list[str], tuple]]:
    """(text, its lines' parts, box) of each sentence of a block; of the whole block if it is one sentence."""
    boxes = [(r["x"], r["y"], r["w"], r["h"]) for r in lines]
    text, spans = joined_with_spans([r["text"] for r in lines], pack)
    ranges = sentence_spans(text, pack)
    out = []
    for start, end in ranges if len(ranges) > 1 else ():
        said, box = text[start:end].strip(), box_over(start, end, spans, boxes)
        if said and box:
            out.append((said, [text[max(a, start) : min(b, end)] for a, b in spans if max(a, start) < min(b, end)], box))
    return out or [(text, [r["text"] for r in lines], box_over(0, len(text), spans, boxes) or boxes[0])]


def sentence_blocks(lines: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, page, ord, kind, text, lines, n_lines, x, y, w, h, confidence: a page's sentences with their boxes.

    Lines (doc_id, page, line_no, text, confidence, x, y, w, h) that are blank or null are left out, the rest put in
    reading order, grouped and cut into sentences. A sentence of a heading, caption, table row or page furniture is of
    that kind; others are list items or paragraphs by themselves. Boxes are cut by code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, p, k, kind, c, i, *s) for d, p, k, kind, c, ls in zip(*[b.column(n).to_pylist() for n in (*PAGE, "block", "kind", "confidence", "lines")], strict=True) for i, s in enumerate(cut_run(ls, pack))]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            boxes = list(zip(*columns[8], strict=True)) or [[]] * 4
            types = [*[b.schema.field(n).type for n in PAGE], pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.string()), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip([*columns[:8], *boxes], types, strict=True)], [*PAGE, "block", "run_kind", "confidence", "seq", "text", "lines", "x", "y", "w", "h"])

    r = runs(lines, pack)
    types = dict(r.dtypes)
    schema = f"doc_id {types['doc_id']}, page {types['page']}, block long, run_kind string, confidence double, seq int, text string, lines array<string>, x double, y double, w double, h double"
    cut = r.select(*PAGE, F.col("block").cast("long").alias("block"), "kind", "confidence", "lines").mapInArrow(run, schema)
    kind = F.when(F.col("run_kind").isin("heading", "pageFurniture", "caption", "tableRow"), F.col("run_kind")).when(T.list_item(F.col("text")), "listItem").otherwise("paragraph")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block", "seq")) - 1
    return cut.select(*PAGE, order.alias("ord"), kind.alias("kind"), "text", "lines", F.size("lines").alias("n_lines"), "x", "y", "w", "h", "confidence")


# --- text layers, recognizers and transcripts ------------------------------------------------------------------------

#: Characters that a text layer needs; how far a character is from its line's middle, in heights, to begin one.
LEAST_CHARACTERS, SHIFT = 24, 0.6
_NEWLINES = frozenset("\n\r\x0b\x0c\x85\u2028\u2029\r\n")


def layer_lines(characters: list[tuple], page: tuple) -> list[tuple[str, tuple]]:
    """(text, box) of each line of a page's characters (character, x, y, w, h; points from the bottom left).

    A character begins a line if its middle is over 0.6 of the line's height from the line's, or if it lies left of the
    line by more than that height. Characters without a finite box of some height go with the line. ``page`` is the
    page's own box; lines' boxes are shares of it from the top left.
    """
    left, bottom, width, height = page
    lines, text, rect = [], "", None

    def flush() -> None:
        nonlocal text, rect
        if rect is None:
            return
        if text.strip():
            x0, y0, x1, y1 = rect
            lines.append((text.strip(), ((x0 - left) / width, 1 - (y1 - bottom) / height, (x1 - x0) / width, (y1 - y0) / height)))
        text, rect = "", None

    for c, x, y, w, h in characters:
        if c in _NEWLINES:
            flush()
            continue
        if x is None or y is None or w is None or h is None or not (math.isfinite(w) and math.isfinite(h) and h > 0):
            text += c
            continue
        if rect is not None:
            tall = rect[3] - rect[1]
            if abs(y + h / 2 - (rect[1] + rect[3]) / 2) > tall * SHIFT or x < rect[0] - tall:
                flush()
        text += c
        own = (x, y, x + w, y + h)
        rect = own if rect is None else (min(rect[0], own[0]), min(rect[1], own[1]), max(rect[2], own[2]), max(rect[3], own[3]))
    flush()
    return lines


def text_layer(characters: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text, confidence, x, y, w, h: the lines that pages carry themselves.

    ``characters`` are (doc_id, page, n, c, x, y, w, h), ``pages`` (doc_id, page, left, bottom, width, height,
    n_characters). A page of under 24 characters, of another number than it says, or without extent has no lines. A
    page's characters are gathered: a page bounds them.
    """
    whole = characters.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("n", "c", *[F.col(k).cast("double").alias(k) for k in "xywh"]))).alias("cs"))
    good = pages.join(whole, PAGE).where((F.col("n") >= LEAST_CHARACTERS) & F.col("n").eqNullSafe(F.coalesce("n_characters", "n")) & (F.col("width") > 0) & (F.col("height") > 0))
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for d, p, *box, cs in zip(*[b.column(n).to_pylist() for n in (*PAGE, "left", "bottom", "width", "height", "cs")], strict=True):
                rows += [(d, p, i, t, 1.0, *xywh) for i, (t, xywh) in enumerate(layer_lines([(c["c"], c["x"], c["y"], c["w"], c["h"]) for c in cs], tuple(box)))]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [*[b.schema.field(n).type for n in PAGE], pa.int32(), pa.string(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [*PAGE, "line_no", "text", "confidence", "x", "y", "w", "h"])

    schema = f"doc_id {types['doc_id']}, page {types['page']}, line_no int, text string, confidence double, x double, y double, w double, h double"
    return good.select(*PAGE, *[F.col(k).cast("double").alias(k) for k in ("left", "bottom", "width", "height")], "cs").mapInArrow(run, schema)


def observed_lines(observations: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text, confidence, x, y, w, h of a recognizer's observations: each one's first candidate.

    Observations are (doc_id, page, line_no, candidates (text, confidence), x, y, w, h), boxes as shares from the bottom
    left; those without a candidate are left out.
    """
    top = F.try_element_at("candidates", F.lit(1))
    y = 1 - (F.col("y") + F.col("h"))
    return observations.where(top.isNotNull()).select(*PAGE, "line_no", top["text"].alias("text"), top["confidence"].alias("confidence"), "x", y.alias("y"), "w", "h")


#: Confidence under which a line is weak, and the share of weak lines from which a page is read again.
WEAK, TOO_WEAK = 0.3, 0.3


def better_attempt(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, attempt, quality: which reading of each page is kept, of lines (doc_id, page, attempt 1 or 2, text,
    confidence).

    A page is read again if the first reading is empty or over 0.3 of its lines are weak; the second reading is kept if
    its characters times their confidence are more.
    """
    first = F.col("attempt") == 1
    score = lambda test: F.coalesce(F.sum(F.when(test, F.char_length("text") * F.col("confidence"))), F.lit(0.0))
    found = lines.groupBy(*PAGE).agg(F.count_if(first).alias("n"), F.count_if(first & (F.col("confidence") < WEAK)).alias("weak"), score(first).alias("one"), score(F.col("attempt") == 2).alias("two"))
    p = pages.select(*PAGE).distinct().join(found, PAGE, "left")
    again = (F.coalesce("n", F.lit(0)) == 0) | (F.col("weak") / F.col("n") > TOO_WEAK)
    second = again & (F.coalesce("two", F.lit(0.0)) > F.coalesce("one", F.lit(0.0)))
    return p.select(*PAGE, F.when(second, 2).otherwise(1).alias("attempt"), F.coalesce(F.when(second, F.col("two")).otherwise(F.col("one")), F.lit(0.0)).alias("quality"))


def transcript_blocks(answers: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, page, ord, kind, text, lines, x, y, w, h, confidence of models' transcripts (doc_id, page, answer).

    Tags of reasoning and fences are taken off, each line normalized and cut into sentences, all of them paragraphs
    over the whole page with no confidence.
    """
    from .profile import cleaned_answer

    each = answers.select(*PAGE, F.posexplode(F.split(cleaned_answer(F.coalesce("answer", F.lit(""))), "\n")).alias("line", "raw"))
    each = each.select(*PAGE, "line", T.normalized(F.col("raw"), pack).alias("text")).where("text <> ''")
    cut = sentences(each, pack, [*PAGE, "line"])
    said = cut.withColumn("text", T.trimmed(F.col("text"))).where("text <> ''")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line", "ord")) - 1
    one = {k: F.lit(v) for k, v in zip("xywh", (0.0, 0.0, 1.0, 1.0), strict=True)}
    return said.select(*PAGE, order.alias("ord"), F.lit("paragraph").alias("kind"), "text", F.array("text").alias("lines"), *[c.alias(k) for k, c in one.items()], F.lit(None).cast("double").alias("confidence"))


# --- sentences -------------------------------------------------------------------------------------------------------


def stop_end(text: str, at: int, pack: Pack) -> int | None:
    """Where the stop at ``at`` ends with the stops and closers after it; None if no sentence ends there."""
    if text[at] not in pack.stops:
        return None
    end = at + 1
    while end < len(text) and (text[end] in pack.stops or text[end] in pack.closers):
        end += 1
    return end if _stop_holds(text, at, end, pack) else None


def stop_locations(text: str, pack: Pack) -> list[int]:
    """Where sentences end."""
    out, i = [], 0
    while i < len(text):
        end = stop_end(text, i, pack)
        if end is not None:
            out.append(end)
        i = end or i + 1
    return out


def ends_sentence(text: str, pack: Pack) -> bool:
    """Whether a text ends with a sentence: its last stop, whatever closers follow, ends it. Blank texts do not."""
    text = text.strip()
    at = len(text) - 1
    while at > 0 and text[at] in pack.closers:
        at -= 1
    return at >= 0 and stop_end(text, at, pack) == len(text)


def sentence_spans(text: str, pack: Pack) -> list[tuple[int, int]]:
    """[start, end) of each sentence: stops with their closers, unless figures, abbreviations or case speak against it."""
    out, start, n = [], 0, len(text)
    stop = _class(pack.stops)
    m = stop.search(text)
    while m:
        end = stop_end(text, m.start(), pack)
        if end is None:
            m = stop.search(text, m.end())
            continue
        if end > start:
            out.append((start, end))
        start = _SPACES.match(text, end).end()
        m = stop.search(text, start)
    if start < n:
        out.append((start, n))
    return out


_SPACES = re.compile(r"\s*")


@cache
def _class(characters: str) -> re.Pattern:
    return re.compile(f"[{re.escape(characters)}]")


@cache
def _lead_in(openers: str) -> re.Pattern:
    return re.compile(rf"[\s{re.escape(openers)}]*")


def _stop_holds(text: str, at: int, end: int, pack: Pack) -> bool:
    if text[at] in pack.stand_alone:
        return True
    if end < len(text):
        if not text[end].isspace():
            return False
        after = _lead_in(pack.openers).match(text, end).end()
        rest = text[after : after + 1]
        if rest and (rest.isnumeric() or pack.opens_with_capital and rest.islower()):
            return False
    if text[at] != ".":
        return True
    start = at
    while start and (text[start - 1] == "." or text[start - 1].isalpha() or text[start - 1].isnumeric()):
        start -= 1
    stem = text[start:at].lower()
    if not stem:
        return True
    numeric = all(c == "." or c.isnumeric() for c in stem)
    initial = pack.single_letter_initial and len(stem) == 1 and stem.isalpha()
    return not (numeric or stem in pack.abbreviations or initial)


def sentences(df: DataFrame, pack: Pack, keys: list[str]) -> DataFrame:
    """keys, ord, start, text: one row a sentence of ``text``; blank and null texts have none."""
    schema = df.select(*keys).withColumns({"ord": F.lit(0), "start": F.lit(0), "text": F.lit("")}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, i, a, t[a:b]) for *k, t in pdf[[*keys, "text"]].itertuples(index=False) if t and t.strip() for i, (a, b) in enumerate(sentence_spans(t, pack))]
            yield pd.DataFrame(rows, columns=[*keys, "ord", "start", "text"])

    return df.select(*keys, "text").mapInPandas(run, schema)


def stops(df: DataFrame, pack: Pack, keys: list[str]) -> DataFrame:
    """keys, ends, ended: where the sentences of ``text`` end, and whether the text ends with one; null texts have none."""
    schema = df.select(*keys).withColumns({"ends": F.array(F.lit(0)), "ended": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([stop_locations(t, pack) for t in texts], pa.list_(pa.int32())), pa.array([ends_sentence(t, pack) for t in texts], pa.bool_())], [*keys, "ends", "ended"])

    return df.select(*keys, "text").mapInArrow(run, schema)
