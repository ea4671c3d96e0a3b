"""Translators and reviewers are plug-ins: pure functions of a text, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pack import Pack
from ..sources.shared import keep
from . import integrity, prompts
from .context import ALONE, GIVEN, cues
from .export import reader_name
from .profile import parsed_verdict, revision_of
from .reconcile import text_similarity


class Engine(Protocol):
    """A translation engine: source text and optional context to target text. A reviewer gets the draft instead."""

    def __call__(self, text: str, context: str | None) -> str: ...


def scripted(answers: dict[str, str], default: Callable[[str], str] = lambda t: f"[{t}]") -> Engine:
    """A deterministic stand-in."""
    return lambda text, context: answers.get(text, default(text))


def _asked(df: DataFrame, lead: Engine, second: Engine | None, reviewer: Engine | None, skip: str, context: str, prefix: str) -> DataFrame:
    """``df`` with prefix_draft, _second, _verdict and _error: what the engines say of ``text``, but where ``skip`` holds.

    An engine that drafts may fail: its exception is the row's error. A second opinion or a review that fails is none;
    neither gets the context, and an empty draft is not reviewed.
    """
    names = [f"{prefix}_{k}" for k in ("draft", "second", "verdict", "error")]
    schema = df.withColumns({k: F.lit(None).cast("string") for k in names}).schema
    for f in schema.fields:
        f.nullable = True

    def tried(engine: Engine | None, *args) -> str | None:
        try:
            return engine(*args) if engine else None
        except Exception:  # noqa: BLE001  there is no second opinion, or no review
            return None

    def one(text: str, around: str | None) -> tuple:
        try:
            draft = lead(text, around)
        except Exception as e:  # noqa: BLE001  the row carries it
            return None, None, None, str(e) or type(e).__name__
        return draft, tried(second, text, None), tried(reviewer if draft else None, text, draft), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(None,) * 4 if s else one(t or "", c) for t, c, s in zip(*[b.column(k).to_pylist() for k in ("text", context, skip)], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4))], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def _judged(df: DataFrame, p: str, pack: Pack, glossary: Column | list | None, terms: Column | dict | None, language: str, compared: int | None = None) -> DataFrame:
    """``df`` with p_revision, p_found and p_like of what its engines said (p_draft, p_second, p_verdict), by whole texts or their first ``compared`` characters."""
    df = df.withColumn(f"{p}_revision", F.when(F.col(f"{p}_verdict").isNotNull(), parsed_verdict(F.col(f"{p}_verdict"))["revision"]))
    ok = F.col(f"{p}_draft").isNotNull()
    found = integrity.findings(F.col("text"), F.coalesce(f"{p}_revision", f"{p}_draft"), pack, glossary, terms, language=language, compared=compared)
    found = F.when(ok, found).otherwise(F.array().cast(integrity.FINDINGS))
    return df.withColumns({f"{p}_found": found, f"{p}_like": F.when(ok & F.col(f"{p}_second").isNotNull(), T.similarity(F.col(f"{p}_draft"), F.col(f"{p}_second"), compared))})


def _told(b: DataFrame, pick: Callable[[str], Column], keep: list[str], language: str) -> DataFrame:
    """Columns ``keep`` of ``b`` and its translation: ``pick`` gives draft, revision, found, like and verdict of the attempt that counts."""
    furniture, failed = F.col("kind") == "pageFurniture", F.col("error").isNotNull()
    b = b.withColumns({
        "first_draft": F.when(F.col("copied"), F.coalesce("text", F.lit(""))).otherwise(F.coalesce(pick("draft"), F.lit(""))), "revision": pick("revision"),
        "findings": pick("found"), "__like": pick("like"), "__reviewed": pick("verdict").isNotNull(),
    })
    none = F.array(integrity.finding("emptyTranslation", integrity.BLOCKING, F.concat(F.lit("This block could not be translated: "), F.col("error"))))
    revised = F.col("revision").isNotNull()
    score = integrity.confidence(F.col("settlement"), F.col("reader"), F.col("agreement"), F.col("findings"), F.col("__like"), F.col("__reviewed"), revised)
    why = integrity.reasons(F.col("settlement"), reader_name(F.col("reader")), F.col("because"), F.col("findings"), F.col("__like"), F.col("__reviewed"), revised)
    b = b.withColumns({
        "score": F.when(F.col("copied"), 1.0).when(failed, 0.0).otherwise(score),
        "reasons": F.when(furniture, F.array(F.lit("Page furniture, kept as printed"))).when(F.col("copied"), F.array(F.lit(f"No {language} in it, kept as printed"))).when(failed, F.array("error")).otherwise(why),
        "findings": F.when(failed, none).otherwise(F.col("findings")),
        "context_reasons": F.when(F.col("copied"), F.array().cast("array<string>")).when(F.col("retried_alone"), F.array(F.lit(ALONE))).otherwise(F.coalesce("context_reasons", F.array().cast("array<string>"))),
    })
    out = b.withColumns({"shown": F.coalesce("revision", "first_draft"), "was_revised": F.coalesce(F.col("revision") != F.col("first_draft"), F.lit(False)), "band": integrity.band(F.col("score"))})
    return out.select(*keep, "copied", "first_draft", "revision", "shown", "was_revised", "findings", "score", "band", "reasons", "context_reasons", "retried_alone", "error")


def _copied(pack: Pack) -> Column:
    return F.coalesce(F.col("kind") == "pageFurniture", F.lit(False)) | ~T.holds_script(F.coalesce("text", F.lit("")), pack)


def translated(blocks: DataFrame, lead: Engine, second: Engine | None, reviewer: Engine | None, pack: Pack, glossary: Column | list | None = None, terms: Column | dict | None = None, language: str = "source language") -> DataFrame:
    """``blocks`` with their translation, its findings and its confidence, each block by itself.

    Blocks are (text, kind, context: what is shown around the text, null for nothing; context_reasons, settlement,
    reader, because, agreement; optionally needed: whether any neighbour is in the context, else taken from its
    being null). Furniture and texts without the source's script are copied, score 1 and reach no
    engine. A block whose engine fails has an empty draft, a blocking finding and score 0. A translation that leaves
    the source, given a neighbour, is asked for once more without it, and replaced if the new one does not. The reviewer
    gets (source, draft) and answers like :func:`~quire.operators.profile.parsed_verdict` expects. Where a block is to be
    shown what the one before it became, see :func:`translated_in_order`.

    Adds copied, first_draft, revision, shown (the revision, else the draft), was_revised, findings, score, band,
    reasons, context_reasons, retried_alone and error.
    """
    rows = blocks.withColumn("copied", _copied(pack))
    first = _asked(rows, lead, second, reviewer, "copied", "context", "__a")
    needed = F.coalesce("needed", F.lit(False)) if "needed" in blocks.columns else F.col("context").isNotNull()
    left = lambda p: F.exists(f"{p}_found", lambda f: f["kind"].isin("echoedSource", "untranslatedScript"))
    a = _judged(first, "__a", pack, glossary, terms, language).withColumn("__done", F.coalesce(F.col("copied") | ~needed | ~left("__a"), F.lit(True)))
    b = _asked(a.withColumn("__alone", F.lit(None).cast("string")), lead, second, reviewer, "__done", "__alone", "__b")
    b = _judged(b, "__b", pack, glossary, terms, language)
    b = b.withColumns({"retried_alone": ~F.col("__done") & F.col("__b_draft").isNotNull() & ~left("__b"), "error": F.col("__a_error")})
    pick = lambda k: F.when(F.col("retried_alone"), F.col(f"__b_{k}")).otherwise(F.col(f"__a_{k}"))
    return _told(b, pick, [c for c in blocks.columns if c not in ("context_reasons", "needed")], language)


# --- in batches ------------------------------------------------------------------------------------------------------

#: An engine that takes many texts at once: (id, text) pairs to (id, answer) pairs in any order, maybe not for all.
BatchEngine = Callable[[list[tuple[int, str]]], list[tuple[int, str]]]


def answers(texts: DataFrame, engine: BatchEngine, size: int = 64, characters: int = 20_000) -> DataFrame:
    """asked, answer, error of the distinct texts of ``texts`` (asked): each is asked once, however many rows hold it.

    A call gets up to ``size`` texts of up to ``characters`` in all (a longer text goes alone). Answers to no text are
    left out, of several to one the first counts, and a text without one has an empty answer. Where a call fails, its texts
    are asked one by one, and what fails then carries its own error. The answers are kept, so that a lost executor
    costs no second question. Nulls are not asked.
    """

    def one(asked: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got: dict[int, str] = {}
            for n, said in engine(list(enumerate(asked))):
                got.setdefault(n, said or "")
            return [(got.get(n, ""), None) for n in range(len(asked))]
        except Exception as e:  # noqa: BLE001  each text carries its own
            if len(asked) == 1:
                return [(None, str(e) or type(e).__name__)]
            return [x for t in asked for x in one([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, room, out = [], 0, []
            for t in b.column("asked").to_pylist():
                if held and (len(held) >= size or room + len(t) > characters):
                    out += zip(held, one(held), strict=True)
                    held, room = [], 0
                held.append(t)
                room += len(t)
            out += zip(held, one(held), strict=True) if held else ()
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in out], pa.string()) for f in (lambda x: x[0], lambda x: x[1][0], lambda x: x[1][1])], ["asked", "answer", "error"])

    asked = texts.select("asked").where("asked is not null").distinct()
    return keep(asked.mapInArrow(run, "asked string, answer string, error string"), "answers")


def translated_in_batches(blocks: DataFrame, lead: BatchEngine, second: BatchEngine | None, pack: Pack, agreed: Column | None = None, glossary: Column | list | None = None, terms: Column | dict | None = None, language: str = "source language", size: int = 64) -> DataFrame:
    """:func:`translated` by engines that take whole batches, each distinct prompt and text once over the table.

    Blocks are (kind, text, settlement, reader, because, agreement). The leading engine gets the prompt of
    :func:`quire.operators.prompts.translation_prompt`: the lines ``agreed`` that hold for a block (an array column), then
    its text; the second the text alone. An answer that is missing is an empty draft; a text that fails has an error.
    Answers meet their blocks by equality of the prompt; a text that very many blocks share makes a skewed join, which
    adaptive execution splits. There is no review and no context, so nothing is asked twice.
    Texts are compared by their first 2000 characters, as in the query's SQL.
    """
    none = F.lit(None).cast("string")
    lines = agreed if agreed is not None else F.array().cast("array<string>")
    rows = blocks.withColumn("copied", _copied(pack))
    rows = rows.withColumns({"__asked": F.when(~F.col("copied"), prompts.translation_prompt(F.col("text"), F.coalesce("kind", F.lit("paragraph")), none, lines)), "__text": F.when(~F.col("copied"), F.col("text"))})
    # blocks that are not asked have no key and would all meet in one task: they are dealt by their text
    dealt = lambda key: F.xxhash64(F.coalesce(key, F.col("text")))
    first = answers(rows.select(F.col("__asked").alias("asked")), lead, size).select(F.col("asked").alias("__asked"), F.xxhash64("asked").alias("__deal"), F.col("answer").alias("__a_draft"), F.col("error").alias("error"))
    rows = rows.drop("error").withColumn("__deal", dealt(F.col("__asked"))).join(first, ["__asked", "__deal"], "left")
    if second is None:
        rows = rows.withColumn("__a_second", none)
    else:
        other = answers(rows.select(F.col("__text").alias("asked")), second, size).where("error is null and answer <> ''")
        other = other.select(F.col("asked").alias("__text"), F.xxhash64("asked").alias("__deal"), F.col("answer").alias("__a_second"))
        rows = rows.withColumn("__deal", dealt(F.col("__text"))).join(other, ["__text", "__deal"], "left")
    rows = rows.withColumns({"__a_verdict": none, "retried_alone": F.lit(False), "context_reasons": F.array().cast("array<string>")})
    return _told(_judged(rows, "__a", pack, glossary, terms, language, T.COMPARED), lambda k: F.col(f"__a_{k}"), [c for c in blocks.columns if c not in ("copied", "context_reasons")], language)


# --- in order --------------------------------------------------------------------------------------------------------


class _Folded:
    """What one document's translation knows as it goes along: the block before, what became of it, the heading above."""

    def __init__(self, pack: Pack, lead: Engine, second: Engine | None, reviewer: Engine | None):
        self.engines, self.script = (lead, second, reviewer), regex.compile(f"[{pack.script}]")
        self.begin()

    def begin(self) -> None:
        self.source = self.target = self.heading = None
        self.stopped = True

    def need(self, r: dict) -> tuple[list[bool], list[str]]:
        """What :func:`quire.operators.context.need` says, from the cues of the text and what went before."""
        before, after, under, head = self.source is not None, r["next_source"] is not None, self.heading is not None, r["kind"] == "heading"
        continues = r["__begins"] or not self.stopped
        tests = [self.target is not None, before and r["__short"], before and r["__refers"], before and continues, after and head, after and not head and r["__short"], under and (r["kind"] in ("listItem", "tableRow") or r["__short"] or r["__refers"])]
        return [before and (r["__short"] or r["__refers"] or continues), tests[0], after and (head or r["__short"]), tests[-1]], [why for t, why in zip(tests, GIVEN, strict=True) if t]

    def around(self, r: dict, need: list[bool]) -> str | None:
        """What :func:`quire.operators.prompts.translation_context` says, and the agreed terms."""
        shown = lambda label, t, end="\n": f"{label}{t}{end}" if t else ""
        near = shown("Under the heading:\n", (self.heading or "")[: prompts.TITLE], "\n\n") if need[3] else ""
        near += shown("The line before:\n", (self.source or "")[-prompts.NEIGHBOUR :]) if need[0] else ""
        near += shown("Translated as:\n", (self.target or "")[-prompts.NEIGHBOUR :]) if need[1] else ""
        near += shown("The line after:\n", (r["next_source"] or "")[: prompts.NEIGHBOUR]) if need[2] else ""
        near += "\nNone of this is to be translated.\n\n" if near else ""
        return shown("From a document titled: ", (r["__title"] or "")[: prompts.TITLE], "\n\n") + near + (r["__terms"] or "") or None

    def ask(self, text: str, context: str | None) -> tuple[str, str | None, str | None]:
        """(draft, second opinion, verdict); only the leading engine's failure is one."""
        lead, second, reviewer = self.engines
        draft = lead(text, context)
        said = []
        for engine, other in ((second, None), (reviewer if draft else None, draft)):
            try:
                said.append(engine(text, other) if engine else None)
            except Exception:  # noqa: BLE001  there is no second opinion, or no review
                said.append(None)
        return draft, *said

    def left(self, text: str, shown: str, kept: list[str]) -> bool:
        """Whether a translation leaves the source: it repeats it, or holds too much of its script."""
        a, b = text.strip(T.SPACES), shown.strip(T.SPACES)
        if not a or not b:
            return False
        x, y = a[: T.COMPARED], b[: T.COMPARED]
        if abs(len(x) - len(y)) <= max(len(x), len(y)) / 10 and text_similarity(x, y) > 0.9:
            return True
        for term in kept:
            b = b.replace(term, "")
        bare = regex.sub(r"[\p{White_Space}\p{P}]", "", b)
        return len(self.script.findall(bare)) > 0.15 * len(bare)

    def block(self, r: dict) -> tuple:
        text, attempts, retried, error = r["text"] or "", [None, None], False, None
        need, why = self.need(r)
        context = None if r["copied"] else self.around(r, need)
        shown = text
        if not r["copied"]:
            final = lambda a: revision_of(a[2]) or a[0] or ""
            try:
                attempts[0] = self.ask(text, context)
            except Exception as e:  # noqa: BLE001  the row carries it
                error = str(e) or type(e).__name__
            if attempts[0] and any(need) and self.left(text, final(attempts[0]), r["__kept"] or []):
                try:
                    attempts[1] = self.ask(text, self.around(r, [False] * 4))
                    retried = attempts[1][0] is not None and not self.left(text, final(attempts[1]), r["__kept"] or [])
                except Exception:  # noqa: BLE001  the first attempt stands
                    pass
            shown = "" if error else final(attempts[retried])
        if r["kind"] == "heading":
            self.heading = shown or text
        if r["kind"] != "pageFurniture":
            self.source, self.target, self.stopped = text, shown, r["__stops"]
        return context, why, *(attempts[retried] or (None,) * 3), retried, error


def translated_in_order(blocks: DataFrame, lead: Engine, second: Engine | None, reviewer: Engine | None, pack: Pack, glossary: Column | list | None = None, terms: Column | dict | None = None, agreed: Column | None = None, language: str = "source language") -> DataFrame:
    """:func:`translated` of whole documents, each block shown what the block before it became.

    Blocks are (doc_id, page, ord, kind, text, settlement, reader, because, agreement). A block is shown what it needs of
    the last translatable block and its translation, of the last heading as it was translated, of the next
    translatable block on its page, the document's title, and the lines ``agreed`` (see
    :func:`quire.operators.prompts.agreed_terms`) that hold for it. What a failed block became is empty. An attempt that
    leaves the source, given any neighbour, is repeated with the title and the agreed lines alone.

    A document's blocks stream through their task in order, with three texts of state, so a document of any length
    takes bounded memory; documents are dealt over the cluster. Each block waits for the one before it, so the
    longest document bounds the time. Null texts are copied as empty; rows of one place (doc_id, page, ord) follow each
    other by kind and text; a null kind is no heading and no furniture; an empty table gives none.

    Texts are compared by their first 2000 characters, as in the query's SQL. Adds context (what the engine was shown) to
    :func:`translated`'s columns.
    """
    title = Window.partitionBy("doc_id")
    after = Window.partitionBy("doc_id", "page").orderBy("ord", "kind", "text").rowsBetween(1, Window.unboundedFollowing)
    ok = F.coalesce(F.col("kind") != "pageFurniture", F.lit(True))
    first = F.struct("page", F.coalesce(F.col("kind") != "heading", F.lit(True)).alias("late"), "ord", F.coalesce("text", F.lit("")).alias("text"))
    short, refers, begins, stops = cues(F.coalesce("text", F.lit("")), pack)
    lines = F.array_join(F.transform(agreed, lambda x: F.concat(F.lit("- "), x)), "\n") if agreed is not None else F.lit("")
    given = glossary if isinstance(glossary, Column) else integrity.literal_glossary(list(glossary or []))
    added = {
        "copied": _copied(pack), "next_source": F.first(F.when(ok, F.coalesce("text", F.lit(""))), ignorenulls=True).over(after), "__title": F.min(F.when(ok, first)).over(title)["text"], "__short": short, "__refers": refers, "__begins": begins, "__stops": stops,
        "__terms": F.when(F.coalesce(lines, F.lit("")) != "", F.concat(F.lit("For this text:\n"), lines, F.lit("\n\n"))), "__kept": F.transform(F.filter(given, lambda g: g["keep"]), lambda g: g["term"]),
    }
    own = [c for c in blocks.columns if c not in (*added, "context", "context_reasons")]
    rows = blocks.select(*own).repartition("doc_id").withColumns(added).sortWithinPartitions("doc_id", "page", "ord", "kind", "text")
    made = {"context": "string", "context_reasons": "array<string>", "__a_draft": "string", "__a_second": "string", "__a_verdict": "string", "retried_alone": "boolean", "error": "string"}
    schema = rows.withColumns({k: F.lit(None).cast(t) for k, t in made.items()}).schema
    for f in schema.fields:
        f.nullable = True
    types = [pa.string(), pa.list_(pa.string()), *[pa.string()] * 3, pa.bool_(), pa.string()]
    read = ["doc_id", "kind", "text", "copied", "next_source", *[k for k in added if k.startswith("__")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, doc = _Folded(pack, lead, second, reviewer), object()
        for b in batches:
            out = []
            for row in zip(*[b.column(k).to_pylist() for k in read], strict=True):
                r = dict(zip(read, row, strict=True))
                if r["doc_id"] != doc:
                    doc = r["doc_id"]
                    state.begin()
                out.append(state.block(r))
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True))], [*b.schema.names, *made])

    folded = rows.mapInArrow(run, schema)
    return _told(_judged(folded, "__a", pack, glossary, terms, language, T.COMPARED), lambda k: F.col(f"__a_{k}"), [*own, "context"], language)
