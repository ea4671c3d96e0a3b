"""What is known of a whole document: survey pages, field, agreed terms; and parsers of models' answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.romanize import not_spelled
from ..sources.shared import keep

#: A field and the stems that speak for it; the first field with one wins.
FIELDS = [
    ("medicine", ["medic", "clinic", "health", "pharma", "prescription", "hospital", "patient", "diagnos", "nursing", "surgery", "discharge summary", "lab report", "laboratory report"]),
    ("law", ["law", "legal", "court", "judic", "judgment", "judgement", "litig", "contract", "statut", "regulat", "attorney", "arbitrat", "notari", "notary", "affidavit", "plaintiff", "defendant", "enforcement notice"]),
    ("finance", ["financ", "account", "audit", "bank", "tax", "invoice", "invest", "insur", "balance sheet", "payroll"]),
    ("engineering", ["engineer", "technic", "manufactur", "construct", "industr", "specification", "software", "chemic", "mechanic", "electric", "datasheet", "data sheet", "manual"]),
    ("scholarship", ["academ", "research", "scholar", "thesis", "dissertation", "journal", "scientific", "universit", "conference paper", "transcript of records"]),
    ("government", ["government", "administrat", "ministr", "municipal", "policy", "public notice", "immigration", "visa", "civil affairs", "household register", "certificate"]),
    ("commerce", ["commerc", "business", "market", "product", "sales", "company profile", "trade", "advertis", "brochure", "purchase order"]),
    ("personal", ["personal", "letter", "famil", "private", "diary", "correspond", "postcard", "memoir"]),
]


def field(description: Column) -> Column:
    """The first field one of whose stems stands in the description, else unknown."""
    low = F.lower(description)
    out = F.lit("unknown")
    for name, stems in reversed(FIELDS):
        out = F.when(low.rlike("|".join(stems)), name).otherwise(out)
    return out


def survey_pages(count: Column, limit: int) -> Column:
    """Evenly spread pages after the first, ``limit`` at most, ending on the last."""
    if limit <= 0:
        return F.array().cast("array<int>")
    rest = count - 1
    all_rest = F.when(rest >= 1, F.sequence(F.lit(1), rest)).otherwise(F.array().cast("array<int>"))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(limit)), lambda i: (F.round((rest - 1) * i / float(limit)) + 1).cast("int")))
    return F.when(rest <= limit, all_rest).otherwise(spread)


#: Characters of the opening, of the whole sample, and of a page at least; pages that are looked at where
#: text costs nothing, and where each must be recognized first.
OPENING, SAMPLE, LEAST_SHARE, FREE_PAGES, RECOGNIZED_PAGES = 2000, 4000, 200, 12, 2


def beginning(text: Column, limit: Column | int) -> Column:
    return T.trimmed(F.left(F.coalesce(text, F.lit("")), limit if isinstance(limit, Column) else F.lit(limit)))


def page_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, page, text: the translatable blocks (doc_id, page, ord, kind, text) of each page, a line each."""
    ok = blocks.where("kind <> 'pageFurniture'")
    return ok.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), "\n").alias("text"))


def survey_sample(pages: DataFrame, has_reader: bool = True) -> DataFrame:
    """doc_id, sample: what a document is judged by, from its pages (doc_id, page from 0, n_pages, layer, read).

    ``layer`` is the text that a page carries itself, ``read`` what a reader makes of it; nulls are none. The opening
    comes first, from whichever there is; then evenly spread pages share what is left of the budget, at least 200
    characters each, while it lasts. Twelve pages are looked at if the last one carries text (or nothing can be read),
    else two; two at most are read. Each part is headed by its page.
    """
    number = lambda c: F.concat(F.lit("[page "), c.cast("string"), F.lit("]\n"))
    first = F.max(F.when(F.col("page") == 0, F.coalesce("layer", "read"))).alias("opening")
    carries = F.coalesce(F.bool_or((F.col("page") == F.col("n_pages") - 1) & F.col("layer").isNotNull()), F.lit(False)).alias("carries")
    docs = pages.groupBy("doc_id").agg(F.max("n_pages").alias("n_pages"), first, carries)
    free = F.col("carries") | F.lit(not has_reader)
    picked = F.when(free, survey_pages(F.col("n_pages"), FREE_PAGES)).otherwise(survey_pages(F.col("n_pages"), RECOGNIZED_PAGES))
    opening = beginning(F.col("opening"), OPENING)
    docs = docs.withColumn("head", F.when(opening != "", F.concat(number(F.lit(1)), opening)).otherwise("")).withColumn("picked", picked)
    docs = docs.withColumn("budget", F.lit(SAMPLE) - F.char_length("head"))
    docs = docs.withColumn("share", F.greatest(F.lit(LEAST_SHARE), F.floor(F.col("budget") / F.greatest(F.size("picked"), F.lit(1))).cast("int")))
    seen = docs.select("doc_id", F.explode("picked").alias("page")).join(pages.select("doc_id", "page", "layer", "read"), ["doc_id", "page"])
    parts = seen.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "layer", "read"))).alias("parts"))  # twelve at most
    start = F.struct(F.col("head").alias("sample"), F.col("budget").alias("budget"), F.lit(0).alias("recognized"))

    def add(acc: Column, p: Column) -> Column:
        layer, may_read = p["layer"], F.lit(has_reader) & (acc["recognized"] < RECOGNIZED_PAGES)
        own = beginning(F.when(layer.isNotNull(), layer).when(may_read, p["read"]), F.least(F.col("share"), acc["budget"]))
        told = F.when((acc["budget"] > 0) & (own != ""), F.concat(F.lit("\n\n"), number(p["page"] + 1), own)).otherwise("")
        read = F.when((acc["budget"] > 0) & layer.isNull() & may_read, 1).otherwise(0)
        return F.struct(F.concat(acc["sample"], told).alias("sample"), (acc["budget"] - F.char_length(told)).alias("budget"), (acc["recognized"] + read).alias("recognized"))

    none = F.array().cast("array<struct<page:int,layer:string,read:string>>")
    joined = docs.join(parts, "doc_id", "left").withColumn("parts", F.coalesce(F.col("parts").cast("array<struct<page:int,layer:string,read:string>>"), none))
    return joined.select("doc_id", F.aggregate("parts", start, add)["sample"].alias("sample"))


#: Characters of terms that one automaton holds; more terms are dealt into several.
SHARD = 1 << 21
#: Terms' rows that a batch of texts brings back at least, but for the last.
TOLD = 1 << 17


def applicable(blocks: DataFrame, keys: list[str], terms: DataFrame, by: str = "term", text: str = "text", shard: int = SHARD) -> DataFrame:
    """``blocks`` with ``terms``: the distinct rows of ``terms`` whose ``by`` stands in the block's text, sorted.

    The texts stream past an automaton of the terms (Aho and Corasick), once for each ``shard`` characters of terms, so
    a text's cost is its length and its matches, however many terms there are. Texts are dealt over tasks; each
    task gets the terms of one shard before its texts, through the same shuffle. Null and blank terms are left out, a
    null text holds none, copies of a block each keep their row. ``keys`` name a block; blocks of one key should be the
    same. An empty table gives none; without terms every block has an empty array.
    """
    spark = blocks.sparkSession
    row = F.struct(by, *[c for c in terms.columns if c != by])
    known = terms.where(F.col(by).isNotNull() & (F.col(by) != "")).distinct().select(row.alias("__t"))
    known = keep(known, "terms")  # few; what they come from may be many, and is gone through once
    size = known.agg(F.sum(F.char_length(f"__t.{by}"))).first()[0] or 0
    shards = max(1, -(-size // shard))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    own = blocks.drop("terms")
    dealt = own.withColumns({"__part": F.pmod(F.xxhash64(*keys) + F.spark_partition_id(), F.lit(parts)), "__shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    dealt = dealt.select("__shard", "__part", F.lit(1).alias("__kind"), F.lit(None).cast(known.schema["__t"].dataType).alias("__t"), F.struct(*own.columns).alias("__b"))
    lists = known.withColumns({"__shard": F.pmod(F.xxhash64(f"__t.{by}"), F.lit(shards)).cast("int"), "__part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    lists = lists.select("__shard", F.col("__part").cast("long").alias("__part"), F.lit(0).alias("__kind"), "__t", F.lit(None).cast(dealt.schema["__b"].dataType).alias("__b"))
    # the rows of one name follow each other, so that a name's are a range
    rows = dealt.union(lists).repartition("__shard", "__part").sortWithinPartitions("__shard", "__part", "__kind", "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, machine, held = None, None, []
        for b in batches:
            shard, part, kind = (b.column(k).to_numpy() for k in ("__shard", "__part", "__kind"))
            entries, blocks_ = b.column("__t"), b.column("__b")
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows]
            for begin, end in pairwise(cuts):
                if (at := (shard[begin], part[begin])) != now:
                    now, machine, held = at, None, []
                if not kind[begin]:
                    held.append(entries.slice(begin, end - begin))
                    continue
                if machine is None:
                    rows_of = pa.concat_arrays(held) if held else entries.slice(0, 0)
                    machine = ahocorasick.Automaton()
                    names = rows_of.field(by).to_pylist()
                    starts = [i for i, n in enumerate(names) if not i or n != names[i - 1]]
                    for i, stop in pairwise([*starts, len(names)]):
                        machine.add_word(names[i], (i, stop))
                    if starts:
                        machine.make_automaton()
                own_, sizes, picked, n = blocks_.slice(begin, end - begin), [], [], 0
                for i, whole in enumerate(own_.field(text).to_pylist()):
                    ranges = sorted({r for _, r in machine.iter(whole)}) if len(machine) and whole else ()
                    sizes.append(sum(stop - i for i, stop in ranges))
                    picked += [k for r in ranges for k in range(*r)]
                    if len(picked) >= TOLD or i + 1 == end - begin:
                        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                        terms_ = pa.ListArray.from_arrays(offsets, rows_of.take(pa.array(picked, pa.int64())))
                        yield pa.RecordBatch.from_arrays([own_.slice(n, len(sizes)), terms_], ["__b", "terms"])
                        n, sizes, picked = i + 1, [], []

    kinds = f"__b {dealt.schema['__b'].dataType.simpleString()}, terms array<{known.schema['__t'].dataType.simpleString()}>"
    met = rows.mapInArrow(run, kinds)
    if shards == 1:
        return met.select("__b.*", F.array_sort("terms").alias("terms"))
    each = met.where(F.size("terms") > 0).select(*[F.col(f"__b.{k}").alias(k) for k in keys], F.explode("terms").alias("t"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_set("t")).alias("__terms"))
    same = [own[k].eqNullSafe(listed[k]) for k in keys]
    return own.join(listed, same, "left").select(*[own[c] for c in own.columns], F.coalesce("__terms", F.array().cast(f"array<{known.schema['__t'].dataType.simpleString()}>")).alias("terms"))


def seen_before(rows: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is among those of ``seen``."""
    return rows.join(seen.select(on).distinct(), on, "left_semi")


def unpinned(terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """Terms that the glossary does not govern already."""
    return terms.join(glossary.select("term"), "term", "left_anti")


#: The marks of answers' lines.
MARKS = {"kind": "KIND:", "field": "FIELD:", "subject": "SUBJECT:", "background": "BACKGROUND:", "register": "REGISTER:", "term": "TERM:", "note": "NOTE:", "name": "NAME:", "question": "QUESTION:", "evidence": "BECAUSE:", "option": "OPTION:", "verdict": "VERDICT:", "revision": "REVISION:"}
NONE, UNKNOWN, REVISE = "NONE", "UNKNOWN", "REVISE"


def parsed_profile(answer: Column) -> Column:
    """struct of a profile answer's marked lines: kind, field, subject, background, register, terms (eight), notes (three).

    Of lines that repeat a mark the last counts; of a term's lines the last one's rendering at the first one's place.
    """

    def of(lines: Column) -> Column:
        one = lambda mark: F.coalesce(F.try_element_at(_marked(lines, MARKS[mark]), F.lit(-1)), F.lit(""))
        split = F.transform(_marked(lines, MARKS["term"]), lambda x: F.split(x, r"\|", 2))
        pairs = F.filter(F.transform(F.filter(split, lambda x: F.size(x) == 2), lambda x: F.struct(T.trimmed(x[0]).alias("term"), T.trimmed(x[1]).alias("rendering"))), lambda p: (p["term"] != "") & (p["rendering"] != ""))

        def settle(acc: Column, p: Column) -> Column:
            known = F.exists(acc, lambda q: q["term"] == p["term"])
            return F.when(F.size(acc) >= 8, acc).when(known, F.transform(acc, lambda q: F.when(q["term"] == p["term"], p).otherwise(q))).otherwise(F.concat(acc, F.array(p)))

        terms = F.aggregate(pairs, F.array().cast("array<struct<term:string,rendering:string>>"), settle)
        named = field(one("field"))
        told = F.when(named != "unknown", named).otherwise(field(F.concat_ws(" ", one("kind"), one("subject"))))
        notes = F.slice(F.filter(_marked(lines, MARKS["note"]), lambda x: x != ""), 1, 3)
        return F.struct(one("kind").alias("kind"), told.alias("field"), one("subject").alias("subject"), one("background").alias("background"), one("register").alias("register"), terms.alias("terms"), notes.alias("notes"))

    return T.let(of, lines=_lines(cleaned_answer(F.coalesce(answer, F.lit("")))))


def parsed_verdict(answer: Column) -> Column:
    """struct(accurate, revision): a marked revision, else accurate unless the answer says REVISE."""

    def of(text: Column) -> Column:
        mark = F.locate(MARKS["revision"], F.upper(text))
        revision = F.when(mark > 0, F.nullif(T.trimmed(F.substring(text, mark + len(MARKS["revision"]), F.char_length(text))), F.lit("")))
        return F.struct(((mark == 0) & ~F.contains(F.upper(text), F.lit(REVISE))).alias("accurate"), revision.alias("revision"))

    return T.let(of, text=cleaned_answer(F.coalesce(answer, F.lit(""))))


def revision_of(answer: str | None) -> str | None:
    """The revision of :func:`parsed_verdict` of one answer; null for none."""
    out = re.sub(r"<think>.*?</think>", "", answer or "", flags=re.S)
    out = re.sub(r"<think>.*$", "", re.sub(r"^.*</think>", "", out, flags=re.S), flags=re.S).strip(T.SPACES)
    out = re.sub(r"^(?:[^\S\n]*```[^\n]*(?:\n|$))+", "", out)
    out = re.sub(r"(?:(?:^|\n)[^\S\n]*(?:```[^\n]*)?)+$", "", out)
    at = out.upper().find(MARKS["revision"])
    return out[at + len(MARKS["revision"]) :].strip(T.SPACES) or None if at >= 0 else None


def cleaned_answer(answer: Column) -> Column:
    """An answer without reasoning tags (closed or not) and the code fences around it, trimmed."""
    out = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)^.*</think>", ""), r"(?s)<think>.*$", "")
    out = F.regexp_replace(T.trimmed(out), r"^(?:[^\S\n]*```[^\n]*(?:\n|$))+", "")
    return F.regexp_replace(out, r"(?:(?:^|\n)[^\S\n]*(?:```[^\n]*)?)+$", "")


#: Announcements of a translation, looked for among an answer's first characters.
ANNOUNCED, ANNOUNCED_WITHIN = ("translates to", "translation:", "the translation is", "here is the translation", "here's the translation", "in english:"), 160


def without_preamble(answer: Column) -> Column:
    """An answer without an announcement before it and the quotation marks around it."""

    def of(text: Column) -> Column:
        low = F.lower(text)
        out = text
        for a in reversed(ANNOUNCED):
            rest = F.regexp_replace(F.substring(text, F.locate(a, low) + len(a), F.char_length(text)), r"^[ :\n\t]+|[ :\n\t]+$", "")
            bare = F.when(rest.rlike("^[\"“]"), F.regexp_replace(F.substring(rest, F.lit(2), F.char_length(rest)), "(?s)[\"”][^\"”]*$", "")).otherwise(rest)
            out = F.when(F.contains(F.left(low, F.lit(ANNOUNCED_WITHIN)), F.lit(a)), F.coalesce(F.nullif(T.trimmed(bare), F.lit("")), text)).otherwise(out)
        return out

    return T.let(of, text=T.trimmed(answer))


def snapped(answer: Column, choices: list[str]) -> Column:
    """An answer as the first of ``choices`` that stands in it, whatever the case; else as it is. Null for an empty one."""
    text = F.nullif(T.trimmed(cleaned_answer(answer)), F.lit(""))
    out = text
    for c in reversed(choices):
        out = F.when(F.contains(F.lower(text), F.lit(c.lower())), c).otherwise(out)
    return out


def token_budget(characters: Column | None = None) -> Column:
    """Tokens that an answer may have: for prose its expected characters within 256 and 8192, for a choice 512."""
    return F.lit(512) if characters is None else F.greatest(F.lit(256), F.least(F.lit(8192), characters))


def _marked(lines: Column, mark: str) -> Column:
    """What follows ``mark`` in the lines that begin with it."""
    return F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: T.trimmed(F.substring(x, F.lit(len(mark) + 1), F.char_length(x))))


def _lines(answer: Column) -> Column:
    return F.transform(F.split(answer, "\n"), lambda x: T.trimmed(x))


def parsed_names(answer: Column, syllables: dict[str, str] | None = None, most: int = 20) -> Column:
    """array of (source, rendering, basis) of an answer's lines ``NAME: source | rendering | basis``.

    Dropped are names without a rendering, renderings that repeat the source, say UNKNOWN or only spell it out by
    ``syllables`` (see :func:`quire.functions.romanize.readings`), and all but the first line of a source. A null answer gives an empty array.
    """
    text = cleaned_answer(F.coalesce(answer, F.lit("")))
    parts = F.transform(_marked(_lines(text), MARKS["name"]), lambda x: F.transform(F.split(x, r"\|"), T.trimmed))
    named = F.transform(F.filter(parts, lambda x: F.size(x) >= 2), lambda x: F.struct(x[0].alias("source"), x[1].alias("rendering"), F.nullif(F.try_element_at(x, F.lit(3)), F.lit("")).alias("basis")))
    good = F.filter(named, lambda n: (n["source"] != "") & (n["rendering"] != "") & (n["source"] != n["rendering"]) & ~F.contains(F.upper(n["rendering"]), F.lit(UNKNOWN)))
    good = not_spelled(good, syllables) if syllables else good
    first = T.let(lambda names: F.filter(names, lambda n, i: F.array_position(F.transform(names, lambda m: m["source"]), n["source"]) == i + 1), names=good)
    return F.when(F.upper(text).startswith(NONE), F.slice(first, 1, 0)).otherwise(F.slice(first, 1, most))


#: The option that every question gets.
UNSURE = ("Not sure", "The reader is not sure; choose the plainest reading.")


def parsed_questions(answer: Column, most: int = 3) -> Column:
    """array of (question, options, evidence) of an answer's lines QUESTION:, BECAUSE: and OPTION: label | guidance.

    A question needs two options; one to say "not sure" is added to each. A null answer gives an empty array.
    """
    text = cleaned_answer(F.coalesce(answer, F.lit("")))
    parts = F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*QUESTION:")

    def question(part: Column) -> Column:
        def of(lines: Column) -> Column:
            pairs = F.transform(F.filter(F.transform(_marked(lines, MARKS["option"]), lambda x: F.split(x, r"\|", 2)), lambda x: F.size(x) == 2), lambda x: F.struct(T.trimmed(x[0]).alias("label"), T.trimmed(x[1]).alias("guidance")))
            unsure = F.array(F.struct(F.lit(UNSURE[0]).alias("label"), F.lit(UNSURE[1]).alias("guidance")))
            options = F.concat(F.filter(pairs, lambda p: (p["label"] != "") & (p["guidance"] != "")), unsure)
            return F.struct(lines[0].alias("question"), options.alias("options"), F.try_element_at(_marked(lines, MARKS["evidence"]), F.lit(-1)).alias("evidence"))

        return T.let(of, lines=_lines(part))

    asked = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), question), lambda q: (q["question"] != "") & (F.size(q["options"]) >= 3))
    return F.when(F.upper(text).startswith(NONE), F.slice(asked, 1, 0)).otherwise(F.slice(asked, 1, most))
