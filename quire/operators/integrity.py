"""Mechanical checks of a source and its translation, and the confidence that follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pack import CHINESE, Pack

NOTE, CAUTION, BLOCKING = 1, 2, 3
#: Type of a block's findings.
FINDINGS = "array<struct<kind:string,severity:int,message:string,evidence:string>>"
#: Types of the agreed terms that apply to a block: the reader's, with what the translation must hold, and the document's.
GLOSSARY, TERMS = "array<struct<term:string,required:string,keep:boolean>>", "array<struct<term:string,rendering:string>>"


def finding(kind: str, severity: Column | int, message: Column | str, evidence: Column | None = None) -> Column:
    s = severity if isinstance(severity, Column) else F.lit(severity)
    m = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("severity"), m.alias("message"), (evidence if evidence is not None else F.lit(None)).cast("string").alias("evidence"))


def _if(test: Column, finding: Column) -> Column:
    return F.when(test, F.array(finding)).otherwise(F.array().cast(FINDINGS))


def _quoted(c: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before + "“"), c, F.lit("”" + after))


def number_differences(source: Column, target: Column, pack: Pack = CHINESE) -> Column:
    """struct(dropped, invented) of figures: multiset differences. What the target writes as words is not dropped; what
    the source holds as often is not invented, in whatever way the target says it besides."""
    none = F.array().cast("array<string>")

    def of(a: Column, b: Column, months: Column, excused: Column) -> Column:
        dropped = F.filter(F.array_distinct(a), lambda x: T.occurrences(a, x) - T.occurrences(excused, x) > T.occurrences(b, x))
        left = F.filter(F.array_distinct(b), lambda x: T.occurrences(b, x) - T.occurrences(months, x) > F.greatest(F.lit(0), T.occurrences(a, x) - T.occurrences(months, x)))
        invented = F.filter(left, lambda x: ~F.exists(T.written_forms(x, pack), lambda w: F.contains(source, w)))
        return F.struct(F.array_sort(dropped).alias("dropped"), F.array_sort(invented).alias("invented"))

    def differing(a: Column, b: Column) -> Column:
        runs = lambda months: T.let(of, a=a, b=b, months=months, excused=F.concat(months, T.spelled(a, target)))
        full = T.let(runs, months=F.when(F.contains(source, F.lit("月")), T.months_as_words(source, target)).otherwise(none))
        return F.when(a == b, F.struct(none.alias("dropped"), none.alias("invented"))).otherwise(full)

    return T.let(differing, a=T.number_runs(source), b=T.number_runs(target))


def literal_glossary(glossary: list[tuple[str, str | None]]) -> Column:
    """A short list of (term, rendering; None to keep it as written) as the column that :func:`findings` takes."""
    rows = [F.struct(F.lit(t).alias("term"), F.lit(t if r is None else r).alias("required"), F.lit(r is None).alias("keep")) for t, r in glossary]
    return F.array(*rows) if rows else F.array().cast(GLOSSARY)


def literal_terms(terms: dict[str, str]) -> Column:
    rows = [F.struct(F.lit(t).alias("term"), F.lit(r).alias("rendering")) for t, r in terms.items()]
    return F.array(*rows) if rows else F.array().cast(TERMS)


def findings(source: Column, target: Column, pack: Pack = CHINESE, glossary: Column | list | None = None, terms: Column | dict | None = None, spelled_names: Column | None = None, language: str = "source language", into: str = "English", compared: int | None = None) -> Column:
    """The findings (kind, severity, message, evidence) of one block, in a fixed order.

    ``glossary`` and ``terms`` are columns (see :data:`GLOSSARY`, :data:`TERMS`), for long lists those that
    :func:`~quire.operators.profile.applicable` joins to each block, or short lists of literals. ``spelled_names`` are
    findings of :func:`~quire.operators.brief.transliterated`, which come before a leak. A translation that echoes
    its source is told by whole texts, or by their first ``compared`` characters. A blank source has no findings, a blank
    translation only emptyTranslation; nulls are blank.
    """
    glossary = glossary if isinstance(glossary, Column) else literal_glossary(list(glossary or []))
    terms = terms if isinstance(terms, Column) else literal_terms(terms or {})
    names = F.coalesce(spelled_names, F.array().cast(FINDINGS)) if spelled_names is not None else F.array().cast(FINDINGS)
    empty = F.array().cast(FINDINGS)

    def checked(s: Column, t: Column) -> Column:
        kept = F.filter(glossary, lambda g: g["keep"])
        measured = F.aggregate(kept, t, lambda acc, g: F.replace(acc, g["term"], F.lit("")))
        listed = lambda *v: _listed(s, t, pack, glossary, terms, names, language, into, compared, *v)
        full = T.let(listed, measured=measured, figures=number_differences(s, t, pack), share=F.when(measured.rlike(f"[{pack.script}]"), T.script_share(measured, pack)).otherwise(0.0), said=T.letters_of(s), letters=T.letters_of(t), plain=F.when(F.contains(t, F.lit("  ")) | ~T.latin(t), T.single_spaced(t)).otherwise(t), leak=T.instruction_leak(t))
        return F.when(s == "", empty).when(t == "", F.array(finding("emptyTranslation", BLOCKING, "A block that has text came back empty."))).otherwise(full)

    return T.let(checked, s=T.trimmed(F.coalesce(source, F.lit(""))), t=T.trimmed(F.coalesce(target, F.lit(""))))


def _listed(s: Column, t: Column, pack: Pack, glossary: Column, terms: Column, names: Column, language: str, into: str, compared: int | None, measured: Column, figures: Column, share: Column, said: Column, letters: Column, plain: Column, leak: Column) -> Column:
    """The findings of a block whose source and translation are not blank."""
    low, high = pack.expansion
    ratio, run = letters / said, T.repeated_in(plain)
    ignored = F.filter(glossary, lambda g: F.contains(s, g["term"]) & ~F.contains(t, g["required"]))
    unlike = F.filter(F.array_sort(terms), lambda x: F.contains(s, x["term"]) & (x["rendering"] != "") & ~F.contains(F.lower(t), F.lower(x["rendering"])) & ~F.exists(glossary, lambda g: g["term"] == x["term"]))
    first = F.regexp_extract(measured, f"[{pack.script}]+", 0)
    return F.concat(
        _if(T.echoes(s, t, compared), finding("echoedSource", BLOCKING, f"The {into} repeats the {language} text.", F.substring(t, 1, 80))),
        _if(share > 0.15, finding("untranslatedScript", F.when(share > 0.4, BLOCKING).otherwise(CAUTION), F.concat(F.floor(share * 100).cast("string"), F.lit(f"% of this block is still {language}.")), F.nullif(F.substring(first, 1, 24), F.lit("")))),
        F.transform(figures["dropped"], lambda x: finding("droppedNumber", BLOCKING, _quoted(x, "The figure ", " of the source is missing."), x)),
        F.transform(figures["invented"], lambda x: finding("inventedNumber", CAUTION, _quoted(x, "The figure ", " is not in the source."), x)),
        _if((said >= 8) & ((ratio < low) | (ratio > high)), finding("lengthOutOfRange", F.when(ratio < low, CAUTION).otherwise(NOTE), F.when(ratio < low, "Far shorter than the source; something may be missing.").otherwise("Far longer than the source; something may have been added."))),
        F.filter(F.array(finding("repeatedRun", BLOCKING, "One phrase is said again and again.", run)), lambda f: f["evidence"].isNotNull()),
        F.transform(ignored, lambda g: finding("briefIgnored", BLOCKING, _quoted(g["term"], "The brief settles ", ", and this block does otherwise."), g["required"])),
        F.transform(unlike, lambda x: finding("inconsistentTerm", CAUTION, F.concat(_quoted(x["term"], "Elsewhere in the document ", " is "), F.lit("“"), x["rendering"], F.lit("”; not here.")), x["rendering"])),
        names,
        _if(leak.isNotNull(), finding("leakedInstruction", CAUTION, "The answer speaks of the task.", leak)),
    )


#: What lowers a score, and what a blocking finding caps it at.
ALONE_BY_MODEL, ALONE, ADJUDICATED, DEFAULTED, DISAGREEMENT = 0.45, 0.2, 0.12, 0.3, 0.4
UNLIKE_DRAFTS, ONE_DRAFT, LEAST_LIKENESS, UNREVIEWED, REVISED = 0.2, 0.05, 0.45, 0.2, 0.1
BY_SEVERITY, CAP = {BLOCKING: 0.4, CAUTION: 0.12, NOTE: 0.04}, 0.35


def confidence(settlement: Column, reader: Column, agreement: Column, found: Column, translator_agreement: Column, reviewed: Column, revised: Column) -> Column:
    """Score in [0, 1] from how a block was read, checked and reviewed. A blocking finding caps it."""
    score = F.lit(1.0) - F.when((settlement == "single") & (reader == "visionLanguageModel"), ALONE_BY_MODEL).when(settlement == "single", ALONE).when(settlement == "adjudicated", ADJUDICATED).when(settlement == "defaulted", DEFAULTED).otherwise(0.0)
    score = score - F.when(agreement < 1, (1 - agreement) * DISAGREEMENT).otherwise(0.0)
    score = score - F.when(translator_agreement.isNull(), ONE_DRAFT).when(translator_agreement < LEAST_LIKENESS, UNLIKE_DRAFTS).otherwise(0.0)
    score = score - F.when(~reviewed, UNREVIEWED).when(revised, REVISED).otherwise(0.0)
    score = F.aggregate(found, score, lambda acc, f: acc - F.when(f.severity == BLOCKING, BY_SEVERITY[BLOCKING]).when(f.severity == CAUTION, BY_SEVERITY[CAUTION]).otherwise(BY_SEVERITY[NOTE]))
    score = F.when(F.exists(found, lambda f: f.severity == BLOCKING), F.least(score, F.lit(CAP))).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def reasons(settlement: Column, reader: Column, because: Column, found: Column, translator_agreement: Column, reviewed: Column, revised: Column) -> Column:
    """Why a block scores as it does: how it was read, translated and reviewed, then each finding's message."""
    read = (
        F.when(settlement == "textLayer", "The document's own text")
        .when(settlement == "unanimous", "Both readers agree")
        .when((settlement == "single") & reader.isin("visionLanguageModel", "Vision model"), "Only a language model read this; it may not stand on the page")
        .when(settlement == "single", F.concat(F.lit("Only "), reader, F.lit(" read this")))
        .when(settlement == "adjudicated", F.concat(F.lit("The readers differ: "), because, F.lit("; "), reader, F.lit(" was chosen")))
        .when(settlement == "defaulted", F.concat(F.lit("The readers differ, unsettled: "), because))
    )
    drafted = F.when(translator_agreement.isNull(), "One translator only").when(translator_agreement < LEAST_LIKENESS, "Two translators differ widely")
    checked = F.when(~reviewed, "Not reviewed").when(revised, "The reviewer rewrote it")
    return F.concat(F.array_compact(F.array(read, drafted, checked)), F.transform(found, lambda f: f["message"]))


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "check").otherwise("low")


def band_label(band_: Column) -> Column:
    """How an export names a band."""
    return F.when(band_ == "high", "Agreed").when(band_ == "check", "Worth a look").otherwise("Needs a human")
