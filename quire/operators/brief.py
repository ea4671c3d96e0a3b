"""A run's brief and engines: edits, guidance, prompts, answers by id, readiness; and names that are only spelled out."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pack import CHINESE, Pack
from ..functions.romanize import Reader
from ..streaming.ledger import admitted_endpoint


def with_term(glossary: DataFrame, term: str, rendering: str | None) -> DataFrame:
    """``glossary`` (term, rendering) with one more term, trimmed; a blank term changes nothing. It replaces its namesake."""
    if not term.strip():
        return glossary
    row = glossary.sparkSession.createDataFrame([(term.strip(), rendering.strip() if rendering and rendering.strip() else None)], "term string, rendering string")
    return without_term(glossary, term.strip()).unionByName(row)


def without_term(glossary: DataFrame, term: str) -> DataFrame:
    return glossary.where(~F.col("term").eqNullSafe(F.lit(term)))


def guidance(kind: Column, field: Column, subject: Column, register: Column, notes: Column) -> Column:
    """A document's guidance, one line each, in a fixed order; nulls and blanks are left out."""
    named = [("Kind", kind), ("Field", F.nullif(field, F.lit("unknown"))), ("Subject", subject), ("Register", register)]
    lines = F.array(*[F.concat(F.lit(f"{n}: "), F.nullif(F.trim(c), F.lit(""))) for n, c in named])
    return F.array_join(F.array_compact(F.concat(lines, F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda x: F.concat(F.lit("Note: "), x)))), "\n")


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """``requests`` (request_id, ...) with answer: that of ``answers`` (request_id, answer) in any order, else empty.

    Of several answers to a request the smallest text counts; answers to nothing are left out.
    """
    one = answers.groupBy("request_id").agg(F.min("answer").alias("answer"))
    return requests.join(one, "request_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


#: Roles that an engine can have: one that reads pages, and those that translate.
READS, TRANSLATES = ("reader", "pageReader"), ("translator", "reviewer")


def can_translate(status: DataFrame, by: list[str]) -> DataFrame:
    """by, ready: whether engines (role, state) hold a ready reader and a ready translator or reviewer."""
    has = lambda roles: F.coalesce(F.bool_or((F.col("state") == "ready") & F.col("role").isin(*roles)), F.lit(False))
    return status.groupBy(*by).agg((has(READS) & has(TRANSLATES)).alias("ready"))


def split_by_readiness(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Engines that are ready, and all others; a null state is not ready."""
    ready = F.coalesce(F.col("state") == "ready", F.lit(False))
    return status.where(ready), status.where(~ready)


def engine_status(built_in: DataFrame, chosen: DataFrame, servers: DataFrame) -> DataFrame:
    """engine, role, state, detail, built_in: all engines' statuses in one table.

    ``built_in`` and ``chosen`` are (engine, role, state, detail); ``servers`` are (engine, role, authority, model) of
    model servers: one whose authority is not loopback is an unavailable row, one without a model none.
    """
    at = admitted_endpoint(F.col("authority"))
    listed = servers.where(at.isNull() | F.col("model").isNotNull()).select(
        F.coalesce(F.when(at.isNotNull(), F.col("model")), F.col("engine")).alias("engine"), "role", F.when(at.isNull(), "unavailable").otherwise("ready").alias("state"),
        F.when(at.isNull(), F.concat(F.lit("not an address of this machine: "), F.col("authority"))).otherwise(at).alias("detail"),
    )
    own = ["engine", "role", "state", "detail"]
    parts = [built_in.select(*own).withColumn("built_in", F.lit(True)), chosen.select(*own).withColumn("built_in", F.lit(False)), listed.withColumn("built_in", F.lit(False))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def leading_engine(has_model: Column, has_machine: Column, follows_instructions: Column, brief_empty: Column, profile_empty: Column) -> Column:
    """struct(lead, second): who drafts and who gives the second opinion, "model" or "machine"; null for none.

    The model leads if it is preferred or if there is a brief or a profile to follow, and if it is there at all.
    """
    model_leads = (follows_instructions | ~brief_empty | ~profile_empty) & has_model
    lead = F.when(model_leads, "model").when(has_machine, "machine").when(has_model, "model")
    second = F.when(model_leads, F.when(has_machine, "machine")).when(has_machine & has_model, "model")
    return F.struct(lead.alias("lead"), second.alias("second"))


#: What can be edited in a brief, and what its rows hold.
BRIEF = "kind string, seq int, term string, rendering string, text string"


def edited(brief: DataFrame, edits: DataFrame) -> DataFrame:
    """``brief`` (kind: term or instruction, seq, term, rendering, text) after ``edits`` (op, seq, term, rendering, text).

    Ops: keep (a term as written), render (a term by a rendering), instruct, remove_term, remove_instruction (by its
    seq). Additions are trimmed and blank ones ignored; they come after what is there, in the edits' order. A removal
    concerns what the brief held before.
    """
    t, r, x = (T.trimmed(F.coalesce(F.col(c), F.lit(""))) for c in ("term", "rendering", "text"))
    gone_terms = edits.where("op = 'remove_term'").select(F.col("term").alias("gone")).distinct()
    gone = edits.where("op = 'remove_instruction'").select(F.col("seq").alias("gone")).distinct()
    stay = brief.join(gone_terms, (brief["kind"] == "term") & (brief["term"] == F.col("gone")), "left_anti")
    stay = stay.join(gone, (stay["kind"] == "instruction") & (stay["seq"] == F.col("gone")), "left_anti")
    added = edits.where(((F.col("op") == "keep") & (t != "")) | ((F.col("op") == "render") & (t != "") & (r != "")) | ((F.col("op") == "instruct") & (x != "")))
    last = brief.agg(F.max("seq")).first()[0] or 0
    new = added.select(
        F.when(F.col("op") == "instruct", "instruction").otherwise("term").alias("kind"), (F.lit(last) + F.col("seq")).cast("int").alias("seq"),
        F.when(F.col("op") != "instruct", t).alias("term"), F.when(F.col("op") == "render", r).alias("rendering"), F.when(F.col("op") == "instruct", x).alias("text"),
    )
    return stay.select(*new.columns).unionByName(new)


def standing(brief: DataFrame) -> DataFrame:
    """The instructions of a brief, in order, as those that every new brief begins with."""
    return brief.where("kind = 'instruction'").select("seq", "text")


#: What preferences are where a key is missing or holds something else. Fixed values.
PREFERENCES = {
    "outputMode": "sameDocument", "useLocalModel": True, "localModelID": "", "textModelID": "", "askClarifyingQuestions": True, "translatorPreference": "followsInstructions",
    "useLocalServer": False, "serverHost": "127.0.0.1", "serverPort": 11434, "serverDialect": "ollama", "serverVisionModel": "qwen2.5vl:7b", "serverTextModel": "qwen3:8b", "standingInstructions": [],
}
OUTPUT_MODES, TRANSLATOR_PREFERENCES, DIALECTS = ("sameDocument", "plainText", "sideBySide"), ("followsInstructions", "fastest"), ("ollama", "openAICompatible")


def preferences(json: Column) -> Column:
    """struct of preferences from JSON: each field by itself, its default where it is missing or of another type.

    Modes, preferences and dialects that are no known name are their defaults as well. Broken JSON is all defaults.
    """
    raw = F.try_parse_json(json)
    kind = F.schema_of_variant
    out = []
    for name, default in PREFERENCES.items():
        v = F.try_variant_get(raw, f"$.{name}", "variant")
        if isinstance(default, bool):
            own = F.when(kind(v) == "BOOLEAN", F.try_variant_get(raw, f"$.{name}", "boolean"))
        elif isinstance(default, int):
            own = F.when(kind(v) == "BIGINT", F.try_variant_get(raw, f"$.{name}", "int"))
        elif isinstance(default, list):
            own = F.when(kind(v).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(raw, f"$.{name}", "array<string>"))
        else:
            own = F.when(kind(v) == "STRING", F.try_variant_get(raw, f"$.{name}", "string"))
        known = {"outputMode": OUTPUT_MODES, "translatorPreference": TRANSLATOR_PREFERENCES, "serverDialect": DIALECTS}.get(name)
        own = F.when(own.isin(*known), own) if known else own
        out.append(F.coalesce(own, F.array().cast("array<string>") if default == [] else F.lit(default)).alias(name))
    return F.struct(*out)


_LETTERS = re.compile(r"[^\W\d_]+")


def spelled_names(source: str | None, target: str | None, syllables: dict[str, str] | Reader, agreed: Iterable[str] = (), pack: Pack = CHINESE, most: int = 3) -> list[tuple[str, str]]:
    """(name, word of the target): stretches of 3 to 6 characters that the target only spells out, longest first.

    Stretches do not overlap; agreed renderings are no fault; runs are read as a whole (see
    :class:`quire.functions.romanize.Reader`), and those with a character that ``syllables`` does not read are passed over. Null texts have none.
    """
    read = syllables if isinstance(syllables, Reader) else Reader(syllables)
    printed = {w.lower(): w for w in reversed(_LETTERS.findall(target or ""))}
    for name in agreed:
        printed.pop("".join(_LETTERS.findall(name.lower())), None)
    found = []
    for run in re.findall(f"[{pack.romanizable}]{{3,}}", source or "") if printed and pack.romanizable else ():
        said = read(run)
        if not said:
            continue
        free = [True] * len(run)
        for n, a in ((n, a) for n in range(min(6, len(run)), 2, -1) for a in range(len(run) - n + 1)):
            word = printed.get("".join(said[a : a + n]))
            if word and all(free[a : a + n]):
                free[a : a + n] = [False] * n
                found.append((run[a : a + n], word))
    return found[:most]


def transliterated(source: Column, target: Column, syllables: dict[str, str], agreed: Iterable[str] = (), pack: Pack = CHINESE, field: str = "unknown") -> Column:
    """Findings (kind, severity, message, evidence) of :func:`spelled_names`, over Arrow batches."""
    read, known, what = Reader(syllables), list(agreed), "generic English drug" if field == "medicine" else "English"

    @F.pandas_udf("array<struct<kind:string,severity:int,message:string,evidence:string>>")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        told = "“{}” is only spelled out; an established " + what + " name belongs here."
        return pd.Series([[{"kind": "transliteratedName", "severity": 2, "message": told.format(n), "evidence": w} for n, w in spelled_names(a, b, read, known, pack)] for a, b in zip(s, t, strict=True)])

    return run(source, target)
