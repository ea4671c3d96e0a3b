"""Translation in order: what a block is shown of the one before, reviews, retries, failures, nulls and long documents."""

import pytest
from pyspark.sql import functions as F

from quire.functions.pack import DIACRITIC
from quire.operators import profile, translate
from quire.operators.context import ALONE

BLOCKS = "doc_id string, page int, ord int, kind string, text string, settlement string, reader string, because string, agreement double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "single", "visionOCR", None, None) for r in rows], BLOCKS)


def told(df):
    return [r.asDict() for r in df.sort("doc_id", "page", "ord").collect()]


def test_each_block_sees_what_the_last_became(spark):
    rows = [("d", 0, 0, "heading", "Über uns"), ("d", 0, 1, "paragraph", "Erste Zeile für alle,"), ("d", 0, 2, "pageFurniture", "Seite é"), ("d", 1, 0, "paragraph", "zweite für alle."), ("d", 1, 1, "paragraph", "No letters of it at all in here."), ("d", 1, 2, None, "dritte für alle, die es gibt."), ("e", 0, 0, "paragraph", "für sich")]
    lead = lambda t, c: f"<{t[:5]}|{(c or '').partition('Translated as:' + chr(10))[2].partition(chr(10))[0]}>"
    review = lambda t, d: f"VERDICT: REVISE\nREVISION: {d} indeed" if t.startswith("Erste") else "VERDICT: ACCURATE"
    got = told(translate.translated_in_order(frame(spark, rows), lead, None, review, DIACRITIC, agreed=F.when(F.col("page") == 1, F.array(F.lit("“a” is “b”.")))))
    shown = [r["shown"] for r in got]
    assert shown[0] == "<Über |>"
    assert shown[1] == "<Erste|<Über |>> indeed"
    assert shown[2] == "Seite é" and got[2]["copied"]
    assert shown[3] == "<zweit|<Erste|<Über |>> indeed>"
    assert shown[4] == "No letters of it at all in here." and got[4]["context"] is None
    assert shown[5] == "<dritt|No letters of it at all in here.>"
    assert shown[6] == "<für s|>"
    assert got[3]["context"] == "From a document titled: Über uns\n\nUnder the heading:\n<Über |>\n\nThe line before:\nErste Zeile für alle,\nTranslated as:\n<Erste|<Über |>> indeed\nThe line after:\nNo letters of it at all in here.\n\nNone of this is to be translated.\n\nFor this text:\n- “a” is “b”.\n\n"
    assert got[1]["was_revised"] and got[1]["first_draft"] == "<Erste|<Über |>>"
    assert [r["score"] for r in got][2] == 1.0


def test_a_copy_is_asked_for_again_with_the_title_alone(spark):
    rows = [("d", 0, 0, "heading", "Größe"), ("d", 0, 1, "paragraph", "Länge über alles")]
    lead = lambda t, c: t if "The line" in (c or "") else f"made of {c!r}"
    got = told(translate.translated_in_order(frame(spark, rows), lead, None, None, DIACRITIC))
    assert [r["retried_alone"] for r in got] == [True, True]
    assert got[1]["shown"] == "made of 'From a document titled: Größe\\n\\n'"
    assert got[1]["context_reasons"] == [ALONE]
    got = told(translate.translated_in_order(frame(spark, rows), lambda t, c: t, None, None, DIACRITIC))
    assert [r["retried_alone"] for r in got] == [False, False] and {f["kind"] for f in got[1]["findings"]} == {"echoedSource"}


def test_title_alone_is_no_reason_to_ask_again(spark):

    def lead(t, c):
        if c is None:
            raise ValueError("asked alone")
        return t

    got = told(translate.translated_in_order(frame(spark, [("d", 0, 0, "paragraph", "Für sich, lang genug und ohne Folge.")]), lead, None, None, DIACRITIC))
    assert not got[0]["retried_alone"] and got[0]["error"] is None
    one = frame(spark, [("d", 0, 0, "paragraph", "Für sich")]).withColumns({"context": F.lit("From a document titled: x\n\n"), "context_reasons": F.array().cast("array<string>"), "needed": F.lit(False)})
    assert not told(translate.translated(one, lead, None, None, DIACRITIC))[0]["retried_alone"]


def test_failures_nulls_and_long_documents(spark):
    rows = [("d", 0, 0, "paragraph", "fällt aus"), ("d", 0, 1, "paragraph", None), ("d", 0, 2, "paragraph", "kürzer")] + [("long", i // 20, i % 20, "paragraph", f"Zeile für {i}") for i in range(3000)]

    def lead(t, c):
        if t == "fällt aus":
            raise ValueError("engine down")
        n = (c or "").partition("Translated as:\nn ")[2].partition("\n")[0]
        return f"n {int(n or -1) + 1}"

    got = told(translate.translated_in_order(frame(spark, rows).withColumns({"next_source": F.lit("clash"), "copied": F.lit(True)}), lead, None, None, DIACRITIC))
    assert got[0]["error"] == "engine down" and got[0]["score"] == 0.0 and got[0]["shown"] == ""
    assert got[1]["shown"] == "" and got[1]["copied"]
    assert [r["shown"] for r in got[3:]] == [f"n {i}" for i in range(3000)]
    assert translate.translated_in_order(frame(spark, rows[:1]).limit(0), lead, None, None, DIACRITIC).count() == 0


@pytest.mark.parametrize("answer", ["VERDICT: REVISE\nREVISION: so ", "```\nrevision: a\n```", "<think>REVISION: no</think>fine", "REVISION:", "", "x\n```\n", "lost</think> REVISION: y", "<think>open REVISION: z"])
def test_revisions_read_alike(spark, answer):
    want = spark.range(1).select(profile.parsed_verdict(F.lit(answer))["revision"]).first()[0]
    assert profile.revision_of(answer) == want


def test_batches(spark):
    """Each text is asked once, in batches; missing answers are empty, a failing batch is asked one by one."""
    texts = [f"Zeile für {i}" for i in range(30)] + ["fällt aus", "ohne Antwört", None, "no letters of it"]
    rows = [("d", 0, i, "heading" if i % 3 == 0 else "paragraph", texts[i % len(texts)]) for i in range(5 * len(texts))]

    def lead(asked):
        assert len(asked) <= 8 and len({t for _, t in asked}) == len(asked)
        if any("fällt aus" in t for _, t in asked):
            raise ValueError("engine down")
        return [(99, "lost")] + [(n, t.rpartition("\n")[2].upper()) for n, t in reversed(asked) if "ohne" not in t] + [(0, "too late")] * ("ohne" not in asked[0][1])

    got = told(translate.translated_in_batches(frame(spark, rows).withColumns({"error": F.lit("clash"), "answer": F.lit("clash")}), lead, lambda asked: [(n, "x") for n, t in asked if "3" in t], DIACRITIC, size=8))
    assert len(got) == len(rows)
    for r, (_, _, _, _, t) in zip(got, rows, strict=True):
        if t in (None, "no letters of it"):
            assert r["copied"] and r["shown"] == (t or "")
        elif t == "fällt aus":
            assert (r["error"], r["score"], r["shown"]) == ("engine down", 0.0, "")
        elif t == "ohne Antwört":
            assert (r["error"], r["shown"], [f["kind"] for f in r["findings"]]) == (None, "", ["emptyTranslation"])
        else:
            assert r["shown"] == t.upper() and ("Two translators differ widely" in r["reasons"]) == ("3" in t)
    assert translate.translated_in_batches(frame(spark, rows[:1]).limit(0), lead, None, DIACRITIC).count() == 0
