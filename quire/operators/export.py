"""Text, Markdown and HTML exports, and search over translated blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import keep
from . import integrity


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain_text(blocks: DataFrame, furniture: bool = False) -> DataFrame:
    """doc_id, body: each document's non-blank blocks (doc_id, page, ord, kind, text) in order, without page furniture.

    A document is one row by nature of the export; its blocks are gathered by sort within the group.
    """
    kept = blocks if furniture else blocks.where("kind <> 'pageFurniture'")
    kept = kept.withColumn("text", T.trimmed(F.coalesce("text", F.lit("")))).where("text <> ''")
    line = F.when((F.col("kind") == "listItem") & ~F.col("text").startswith("•"), F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text"))
    body = kept.select("doc_id", F.struct("page", "ord", line.alias("line")).alias("b")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["line"]), "\n\n").alias("body"))
    return body.select("doc_id", F.concat("body", F.lit("\n")).alias("body"))


#: Styles of the exports that show more than the text; formats with their file ends; modes with theirs. Fixed values.
STYLES, FORMATS, MODES = ("englishOnly", "bilingual", "audit"), {"markdown": "md", "html": "html"}, {"sameDocument": "pdf", "plainText": "txt", "sideBySide": "html"}
#: How an HTML export names a band.
CLASSES = {"high": "agreed", "check": "look", "low": "human"}
SHEET = "body{max-width:60rem;margin:auto;font:1rem/1.6 sans-serif}.source{color:#555}.look{border-left:3px solid #c90}.human{border-left:3px solid #c00}.note{font-style:italic}"


def file_name(name: Column, mode_or_format: str) -> Column:
    """What an export of a document is called: its own name without its end, -en, and the end of the mode or format."""
    base = F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^./]*$", ""), F.lit("")), F.lit("translation"))
    return F.concat(base, F.lit(f"-en.{(MODES | FORMATS)[mode_or_format]}"))


#: How readers are named in what people read.
READERS = {"pdfTextLayer": "Text layer", "visionOCR": "Recognizer", "visionLanguageModel": "Vision model"}


def reader_name(reader: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, reader), reader)


def settled(settlement: Column, reader: Column, because: Column) -> Column:
    """How a block's text was settled, in words."""
    r = reader_name(reader)
    return (
        F.when(settlement == "unanimous", "Both readers agreed").when(settlement == "single", F.concat(F.lit("Only "), r, F.lit(" read this"))).when(settlement == "textLayer", "Taken from the document's own text")
        .when(settlement == "adjudicated", F.concat(F.lit("Settled on "), r, F.lit(": "), because)).when(settlement == "defaulted", F.concat(F.lit("Kept "), r, F.lit(": "), because))
    )


def provenance(languages: Column, readers: Column, summary: Column, names: Column, translator: Column, reviewer: Column, attention: Column, total: Column, finished: Column) -> Column:
    """The lines that every export begins with: what was done, by which engines, and how much of it is doubtful.

    ``readers`` are an array, ``names`` one of (source, rendering); null and empty parts have no line.
    """
    said = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    listed = F.array_join(F.transform(names, lambda n: F.concat(n["source"], F.lit(" → "), n["rendering"])), "; ")
    doubt = F.when(attention == 0, F.concat(F.lit("All "), total.cast("string"), F.lit(" blocks passed every check."))).otherwise(
        F.concat(attention.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" blocks need a look by someone; they are marked below."))
    )
    return F.array_compact(F.array(
        F.concat(languages, F.lit(", translated on this machine.")), F.lit("Nothing of this document was uploaded."), F.concat(F.lit("Read by: "), F.array_join(readers, ", ")),
        said("Translated as: ", summary), said("Names looked up: ", listed), said("Translated by: ", translator), said("Reviewed by: ", reviewer), doubt, F.date_format(finished, "yyyy-MM-dd HH:mm"),
    ))


def summaries(blocks: DataFrame) -> DataFrame:
    """doc_id, attention, total of blocks (doc_id, kind, band): those not in the high band, and those that are translated."""
    return blocks.groupBy("doc_id").agg(F.count_if(F.col("band") != "high").alias("attention"), F.count_if(F.col("kind") != "pageFurniture").alias("total"))


def _markdown(style: str) -> Column:
    text, kind = F.col("__t"), F.col("kind")
    own = F.when(kind == "heading", F.concat(F.lit("### "), text)).when(kind == "listItem", F.concat(F.lit("- "), text)).when(kind == "pageFurniture", F.concat(F.lit("*"), text, F.lit("*"))).otherwise(text)
    parts = [F.concat(F.lit("> "), F.col("source"), F.lit("\n\n"))] if style != "englishOnly" else []
    parts += [own, F.lit("\n\n")]
    note = F.concat(F.lit("*⚠︎ "), integrity.band_label(F.col("band")), F.lit(" — "), F.array_join("reasons", "; "), F.lit("*\n\n"))
    parts.append(F.when(F.col("band") != "high", note).otherwise(""))
    if style == "audit":
        item = lambda label, c: F.concat(F.lit(f"- **{label}:** "), c, F.lit("\n"))
        read = F.transform(F.array_sort("candidates"), lambda c: F.concat(F.lit("- **"), reader_name(c["reader"]), F.lit(":** "), c["text"], F.lit("\n")))
        checks = F.transform("findings", lambda f: F.concat(F.lit("- **Check:** "), f["message"], F.lit("\n")))
        parts += [F.lit("<details><summary>How this block was read</summary>\n\n"), F.array_join(read, ""), item("Settled", F.col("settled")), F.when(F.col("was_revised"), item("First draft", F.col("first_draft"))).otherwise(""), F.array_join(checks, ""), F.lit("\n</details>\n\n")]
    return F.concat(*parts)


def _html(style: str) -> Column:
    text, kind, band = escaped(F.col("__t")), F.col("kind"), F.col("band")
    tag = F.when(kind == "heading", F.concat(F.lit("<h3>"), text, F.lit("</h3>"))).when(kind == "listItem", F.concat(F.lit("<ul><li>"), text, F.lit("</li></ul>"))).when(kind == "pageFurniture", F.concat(F.lit('<p class="furniture">'), text, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
    named = F.when(band == "high", CLASSES["high"]).when(band == "check", CLASSES["check"]).otherwise(CLASSES["low"])
    parts = [F.lit('<section class="block '), named, F.lit('">\n')]
    if style != "englishOnly":
        parts += [F.lit('<div class="source" lang="'), F.col("source_lang"), F.lit('">'), escaped(F.col("source")), F.lit("</div>\n")]
    parts += [F.lit('<div class="target">'), tag, F.lit("</div>\n")]
    note = F.concat(F.lit('<p class="note">'), escaped(integrity.band_label(band)), F.lit(" — "), escaped(F.array_join("reasons", "; ")), F.lit("</p>\n"))
    parts.append(F.when(band != "high", note).otherwise(""))
    if style == "audit":
        item = lambda label, c: F.concat(F.lit(f"<dt>{label}</dt><dd>"), escaped(c), F.lit("</dd>"))
        read = F.transform(F.array_sort("candidates"), lambda c: F.concat(F.lit("<dt>"), escaped(reader_name(c["reader"])), F.lit("</dt><dd>"), escaped(c["text"]), F.lit("</dd>")))
        why = F.array_join("context_reasons", "; ")
        given = F.when(F.col("retried_alone"), item("Translated twice", why)).when(F.size("context_reasons") > 0, item("Also given", why)).otherwise("")
        checks = F.transform("findings", lambda f: F.concat(F.lit("<dt>Check</dt><dd>"), escaped(f["message"]), F.lit("</dd>")))
        parts += [F.lit('<details class="working"><summary>How this block was read</summary><dl>'), F.array_join(read, ""), item("Settled", F.col("settled")), given, F.when(F.col("was_revised"), item("First draft", F.col("first_draft"))).otherwise(""), F.array_join(checks, ""), F.lit("</dl></details>\n")]
    return F.concat(*parts, F.lit("</section>\n"))


def styled(blocks: DataFrame, documents: DataFrame, style: str = "englishOnly", form: str = "markdown") -> DataFrame:
    """doc_id, body: each of ``documents`` (doc_id, name, n_pages, provenance, source_lang, target_lang) in one of STYLES.

    Blocks are (doc_id, page, ord, kind, text, source, band, reasons) and, for the audit style, candidates (reader,
    text), settled, first_draft, was_revised, findings, context_reasons and retried_alone; pages count from 0. Blocks
    without text are left out; a document of one page has no page heads; one without blocks has its head alone.
    """
    if style not in STYLES or form not in FORMATS:
        raise ValueError(f"no such export: {style}, {form}")
    known = documents.select("doc_id", "n_pages", "source_lang")
    rows = blocks.withColumn("__t", T.trimmed(F.coalesce("text", F.lit("")))).where("__t <> ''").join(known, "doc_id").where("page between 0 and n_pages - 1")
    head = lambda page: F.concat(F.lit("## Page " if form == "markdown" else '<h2 class="page">Page '), (page + 1).cast("string"), F.lit("\n\n" if form == "markdown" else "</h2>\n"))
    # heads of the pages from one to another, none where they are none or the document has one page
    heads = lambda first, last, n: F.when((n > 1) & (first <= last), F.array_join(F.transform(F.sequence(first, last), head), "")).otherwise("")

    def told(b: Column, n: Column) -> Column:
        line = lambda x, i: F.concat(heads(F.when(i == 0, 0).otherwise(F.try_element_at(b, F.greatest(i, F.lit(1)))["page"] + 1), x["page"], n), F.coalesce(x["line"], F.lit("")))
        return F.concat(F.array_join(F.transform(b, line), ""), heads(F.element_at(b, -1)["page"] + 1, n - 1, n))

    # blocks meet their document, are drawn and gathered where one shuffle by document has brought them
    drawn = rows.select("doc_id", F.struct(F.col("page").cast("int").alias("page"), "ord", (_markdown(style) if form == "markdown" else _html(style)).alias("line")).alias("b"))
    gathered = drawn.groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("__b"))
    d = documents.join(gathered, "doc_id", "left").withColumn("__n", F.col("n_pages").cast("int"))
    lines_ = F.when(F.col("__b").isNotNull(), T.let(told, b=F.col("__b"), n=F.col("__n"))).otherwise(heads(F.lit(0), F.col("__n") - 1, F.col("__n")))
    d = d.withColumn("lines", F.coalesce(lines_, F.lit("")))
    if form == "markdown":
        return d.select("doc_id", F.concat(F.lit("# "), "name", F.lit("\n\n"), F.array_join(F.transform("provenance", lambda x: F.concat(F.lit("> "), x, F.lit("\n"))), ""), F.lit("\n"), "lines").alias("body"))
    name, lines = escaped(F.col("name")), F.array_join(F.transform("provenance", escaped), "<br>\n")
    top = F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), "target_lang", F.lit('">\n<head>\n<meta charset="utf-8">\n<title>'), name, F.lit(f'</title>\n<style>{SHEET}</style>\n</head>\n<body class="{style}">\n'))
    return d.select("doc_id", F.concat(top, F.lit("<header>\n<h1>"), name, F.lit('</h1>\n<p class="provenance">'), lines, F.lit("\n</p>\n</header>\n"), "lines", F.lit("\n</body>\n</html>")).alias("body"))


def derived(blocks: DataFrame) -> DataFrame:
    """``blocks`` (first_draft, revision, agreement) with text, was_revised, was_contested and was_double_checked."""
    return blocks.withColumns({
        "text": F.coalesce("revision", "first_draft"), "was_revised": F.coalesce(F.col("revision") != F.col("first_draft"), F.lit(False)),
        "was_contested": F.coalesce(F.col("agreement") < 1, F.lit(False)), "was_double_checked": F.col("agreement").isNotNull(),
    })


def search(blocks: DataFrame, query: str) -> DataFrame:
    """Blocks that hold ``query`` in source or target, whatever the case."""
    q = F.lit(query.lower())
    return blocks.where(F.contains(F.lower("text"), q) | F.contains(F.lower(F.coalesce("target", F.lit(""))), q))


def pages(blocks: DataFrame) -> DataFrame:
    """doc_id, page, n_blocks, n_translatable, first_text of each page."""
    first = F.min(F.struct("ord", "text"))
    return blocks.groupBy("doc_id", "page").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") != "pageFurniture").alias("n_translatable"), first["text"].alias("first_text"))


def queue_target(queue: DataFrame, cursors: DataFrame, by: list[str]) -> DataFrame:
    """The block that each cursor (by, at) stands on in its queue (by, score, page, ord): the cursor wraps; under 0 none.

    No queue is sorted: blocks are counted by score, then those of the score that the cursor falls on by page, and only
    the blocks of that page are put in order. ``queue`` is worked out once and kept. Adds of: the blocks in the queue.
    """
    kept = keep(queue, "queue")
    joined = lambda d, other, keys: d.join(other.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) if k in ("score", "page") else F.col(k) == F.col(f"__{k}") for k in keys]).drop(*[f"__{k}" for k in keys])

    def reached(counts: DataFrame, group: list[str], k: str) -> DataFrame:
        """Of each group's values of ``k`` (with how many blocks have it) the one that __left blocks come before."""
        before = F.sum("__of").over(Window.partitionBy(*group).orderBy(k)) - F.col("__of")
        placed = counts.withColumn("__before", before).where(F.col("__left").between(F.col("__before"), F.col("__before") + F.col("__of") - 1))
        return placed.withColumn("__left", F.col("__left") - F.col("__before")).drop("__before", "__of")

    # kept as well: both steps after it read it
    scores = keep(kept.groupBy(*by, "score").agg(F.count("*").alias("__of")), "queue-scores")
    asked = joined(cursors.where("at >= 0").select(*by, "at").distinct(), scores.groupBy(*by).agg(F.sum("__of").alias("of")), by)
    at_score = reached(joined(scores, asked.withColumn("__left", F.pmod("at", "of")), by), [*by, "at"], "score")
    pages_ = joined(kept, at_score, [*by, "score"]).groupBy(*by, "at", "of", "score", "__left", "page").agg(F.count("*").alias("__of"))
    at_page = reached(pages_, [*by, "at"], "page")
    nth = F.row_number().over(Window.partitionBy(*by, "at").orderBy("ord")) - 1
    found = joined(kept, at_page, [*by, "score", "page"]).withColumn("__nth", nth).where("__nth = __left").drop("__nth", "__left")
    return found.join(cursors, [*by, "at"])


def stepped(at: Column, delta: Column, n: Column) -> Column:
    """A queue's cursor after a step of ``delta`` among ``n`` blocks: it wraps at both ends and stays in an empty queue."""
    return F.when(n == 0, at).when(at < 0, F.when(delta > 0, F.lit(0)).otherwise(n - 1)).otherwise(F.pmod(at + delta, n))
