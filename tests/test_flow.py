"""Operators that SQL cannot express, against plain Python; and limits that must not cut anything."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.pack import CHINESE, DIACRITIC
from quire.operators import brief, catalogue, export, integrity, layout, profile, prompts, reconcile
from quire.sources import tables


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_sentences_and_stops():
    cut = lambda t, p=CHINESE: [t[a:b] for a, b in layout.sentence_spans(t, p)]
    assert cut("甲方付款。乙方交货！“好。”完") == ["甲方付款。", "乙方交货！", "“好。”", "完"]
    assert cut("Ver 3.5 of it. Co. says no. 5 more.", DIACRITIC) == ["Ver 3.5 of it.", "Co. says no. 5 more."]
    assert layout.stop_locations("一。二！", CHINESE) == [2, 4]
    assert [layout.ends_sentence(t, CHINESE) for t in ("好。", "好。”）", "好", "", "”", "a.")] == [True, True, False, False, False, True]


def test_sentence_blocks(spark):
    rows = [("d", 0, 0, "第一条甲方应当付款。乙方应", 0.1, 0.20, 0.8, 0.02), ("d", 0, 1, "当交货。", 0.1, 0.225, 0.4, 0.02), ("d", 0, 2, "　", 0.1, 0.25, 0.4, 0.02), ("d", 0, 3, "附件", 0.1, 0.60, 0.2, 0.05), ("d", 1, 0, None, 0.1, 0.2, 0.1, 0.02)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id string, page int, line_no int, text string, x double, y double, w double, h double, confidence double")
    got = [(r["ord"], r["kind"], r["text"], r["lines"], [round(r[k], 4) for k in "xywh"], r["confidence"]) for r in layout.sentence_blocks(df, CHINESE).sort("ord").collect()]
    width = 0.8 / 13
    assert got == [
        (0, "listItem", "第一条甲方应当付款。", ["第一条甲方应当付款。"], [0.1, 0.2, round(width * 10, 4), 0.02], 0.5), (1, "paragraph", "乙方应当交货。", ["乙方应", "当交货。"], [0.1, 0.2, 0.8, 0.045], 0.5), (2, "heading", "附件", ["附件"], [0.1, 0.6, 0.2, 0.05], 0.5),
    ]
    assert layout.sentence_blocks(df.limit(0), CHINESE).count() == 0
    assert layout.joined_with_spans(["ab", "cd", "中", "x"], CHINESE) == ("ab cd中x", [(0, 2), (3, 5), (5, 6), (6, 7)])


def test_transcripts(spark):
    answer = "<think>hm <think> more</think>\n```text\n甲方付款。乙方 交货。\n　\n第 3 页\n```\n"
    df = spark.createDataFrame([("d", 0, answer), ("d", 1, None), ("d", 2, "```\n```")], "doc_id string, page int, answer string")
    assert [(r["ord"], r["text"], r["confidence"], r["w"]) for r in layout.transcript_blocks(df, CHINESE).sort("ord").collect()] == [(0, "甲方付款。", None, 1.0), (1, "乙方交货。", None, 1.0), (2, "第 3 页", None, 1.0)]
    clean = lambda t: one(spark, profile.cleaned_answer(F.lit(t)))
    assert [clean(t) for t in ("lost</think> yes", "<think>open", "```a\n```b\nx\n\n```", "a <think>b</think> c", "```")] == ["yes", "", "x", "a  c", ""]
    bare = lambda t: one(spark, profile.without_preamble(F.lit(t)))
    assert [bare(t) for t in ('The text “你” translates to: "You".', "Translation: yes", "translation:", "no announcement", "x" * 200 + "translation: y")] == ["You", "yes", "translation:", "no announcement", "x" * 200 + "translation: y"]
    assert [one(spark, c) for c in (profile.token_budget(F.lit(10)), profile.token_budget(F.lit(9000)), profile.token_budget())] == [256, 8192, 512]


def test_text_layer(spark):
    at = lambda text, y, x=0.0: [(c, x + 6.0 * i, y, 6.0, 10.0) for i, c in enumerate(text)]
    page = (0.0, 0.0, 600.0, 800.0)
    chars = at("first line", 700.0) + at("second", 680.0) + [("\n", 0.0, 0.0, 0.0, 0.0)] + at(" third ", 680.0, 300.0) + [("x", None, None, None, None)] + at("fell back", 680.0)
    assert [t for t, _ in layout.layer_lines(chars, page)] == ["first line", "second", "third x", "fell back"]
    assert layout.layer_lines(at("ab", 700.0), page)[0][1] == (0.0, 1 - 710.0 / 800, 12.0 / 600, 10.0 / 800)
    df = spark.createDataFrame([("d", 0, i, *c) for i, c in enumerate(at("x" * 23, 1.0))], "doc_id string, page int, n int, c string, x double, y double, w double, h double")
    pages = spark.createDataFrame([("d", 0, 0, 0, 600, 800, None)], "doc_id string, page int, left int, bottom int, width int, height int, n_characters int")
    assert layout.text_layer(df, pages).count() == 0  # under 24 characters
    assert layout.text_layer(df.union(df.limit(1).withColumn("n", F.lit(99))), pages).count() == 1


def test_reconciled(spark):
    block = lambda text, kind="paragraph": dict(text=text, kind=kind, n_lines=1, x=0.1, y=0.1, w=0.5, h=0.1)
    asked = []

    def judge(before, a, b):
        asked.append((before, a, b))
        if "坏" in a:
            raise ValueError("engine down")
        return "b"

    left = [block("第一条 甲方应当付款给乙方"), block("共计1000元整的款项"), block("乙方应当交付货物"), block("坏的甲方与乙方的合同"), block("只有识别器读到这个")]
    right = [block("第一条甲方应当付歉给乙方"), block("第一条甲方应当付歉给乙方"), block("共计7000元整的款项"), block("乙方应当交付货物"), block("坏的甲方与乙方的台同"), block("完全不同的另外一句话在这里出现了而已")]
    got = reconcile.reconcile_page({"visionOCR": left, "visionLanguageModel": right}, CHINESE, judge)
    assert [(b["settlement"], b["reader"], b["text"]) for b in got] == [
        ("adjudicated", "visionLanguageModel", "第一条甲方应当付歉给乙方"), ("defaulted", "visionOCR", "共计1000元整的款项"), ("unanimous", "visionOCR", "乙方应当交付货物"), ("defaulted", "visionOCR", "坏的甲方与乙方的合同"),
        ("single", "visionLanguageModel", "完全不同的另外一句话在这里出现了而已"), ("single", "visionOCR", "只有识别器读到这个"),
    ]
    assert got[0]["because"] == "“款” against “歉”" and got[1]["because"] == reconcile.BECAUSE_FIGURES and got[3]["because"] == "engine down"
    assert [b["context_before"] for b in got] == [None, *(b["text"] for b in got[:-1])] and [a for a, _, _ in asked] == [None, "乙方应当交付货物"]
    assert got[5]["agreement"] is None and got[4]["agreement"] == 0
    layer = reconcile.reconcile_page({"pdfTextLayer": left[:1], "visionOCR": right[:1]}, CHINESE, judge)
    assert (layer[0]["settlement"], layer[0]["text"]) == ("textLayer", "第一条甲方应当付款给乙方")
    assert reconcile.reconcile_page({"visionLanguageModel": left[:1], "visionOCR": []}, CHINESE)[0]["settlement"] == "single"
    assert reconcile.reconcile_page({}, CHINESE) == []
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("ab 中国　1１.,") for _ in range(r.randrange(12))) for _ in range(2))
        df = spark.range(1).select(T.normalized(F.lit(a), CHINESE).alias("n"), T.number_runs(F.lit(a)).alias("f"), T.quoted_difference(F.lit(a), F.lit(b)).alias("d")) if r.random() < 0.1 else None
        if df is not None:
            assert tuple(df.first()) == (reconcile.normalize(a, CHINESE), reconcile.figures(a), reconcile.difference(a, b))
    df = spark.createDataFrame([("d", 0, "visionOCR", i, x["kind"], x["text"], 1, 0.1, 0.1 * i, 0.5, 0.1) for i, x in enumerate(left)], "doc_id string, page int, reader string, ord int, kind string, text string, n_lines int, x double, y double, w double, h double")
    assert [r["text"] for r in reconcile.reconciled(df, CHINESE).sort("ord").collect()] == [x["text"] for x in left] and reconcile.reconciled(df.limit(0), CHINESE).count() == 0


def brute_sample(n_pages, layer, read, has_reader=True):
    begin = lambda t, k: (t or "")[:k].strip()
    opening = begin(layer.get(0) or read.get(0), 2000)
    out = "[page 1]\n" + opening if opening else ""
    budget = 4000 - len(out)
    if budget <= 0 or n_pages < 2:
        return out
    limit = 12 if (n_pages - 1) in layer or not has_reader else 2
    rest = list(range(1, n_pages))
    pages = rest if len(rest) <= limit else list(dict.fromkeys(rest[int((len(rest) - 1) * s / limit + 0.5)] for s in range(1, limit + 1)))
    share, seen = max(200, budget // max(1, len(pages))), 0
    for p in pages:
        if budget <= 0:
            break
        if p in layer:
            text = begin(layer[p], min(share, budget))
        elif has_reader and seen < 2:
            seen += 1
            text = begin(read.get(p), min(share, budget))
        else:
            continue
        if text:
            part = f"\n\n[page {p + 1}]\n{text}"
            out, budget = out + part, budget - len(part)
    return out


def test_survey_sample(spark):
    r = random.Random(2)
    rows, want = [], {}
    for d in range(40):
        n = r.choice([1, 2, 3, 5, 14, 30])
        text = lambda: r.choice([" ", "word "]) * r.randrange(1, 700)
        layer = {p: text() for p in range(n) if r.random() < (0.0, 0.5, 1.0)[d % 3]}
        read = {p: text() for p in range(n) if r.random() < 0.8}
        rows += [(d, p, n, layer.get(p), read.get(p)) for p in range(n)]
        want[d] = {h: brute_sample(n, layer, read, h) for h in (True, False)}
    df = spark.createDataFrame(rows, "doc_id int, page int, n_pages int, layer string, read string")
    for has in (True, False):
        assert {x["doc_id"]: x["sample"] for x in profile.survey_sample(df, has).collect()} == {d: w[has] for d, w in want.items()}


def test_terms_beyond_any_limit(spark):
    """Terms are found whatever their number and length, by one automaton or by several."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcd中") for _ in range(r.randrange(1, 6)))
    terms = sorted({word() for _ in range(768)} | {f"term{i}" for i in range(12_000)})
    texts = [(i, " ".join(word() for _ in range(r.randrange(0, 12)))) for i in range(60)] + [(100, "term11999 and term7"), (101, ""), (102, None)]
    df, t = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x, x.upper()) for x in terms] + [("", ""), (None, None)], "term string, rendering string")
    got = {x["id"]: [y["term"] for y in x["terms"] or []] for x in profile.applicable(df, ["id"], t).collect()}
    assert got == {i: [x for x in terms if x in (text or "")] for i, text in texts}
    many = profile.applicable(df.union(df).withColumns({"terms": F.lit("clash"), "t": F.lit(1)}), ["id"], t, shard=20_000).collect()
    assert len(many) == 2 * len(texts) and all([y["term"] for y in x["terms"]] == got[x["id"]] for x in many)
    assert all(x["terms"] == [] for x in profile.applicable(df, ["id"], t.limit(0)).collect()) and profile.applicable(df.limit(0), ["id"], t).count() == 0
    few = {x["id"]: [y["term"] for y in x["terms"] or []] for x in profile.applicable(df, ["id"], t.where("term in ('a', 'ab', 'term7', '中')")).collect()}
    assert few == {i: [x for x in ("a", "ab", "term7", "中") if x in (text or "")] for i, text in texts}
    glossary = t.select("term", F.col("rendering").alias("required"), F.lit(False).alias("keep"))
    own = profile.applicable(df, ["id"], glossary).withColumn("f", integrity.findings(F.col("text"), F.lit("no such rendering, TERM7"), CHINESE, F.col("terms")))
    found = {x["id"]: [y["evidence"] for y in x["f"] if y["kind"] == "briefIgnored"] for x in own.collect()}
    assert set(found[100]) == {x.upper() for x in got[100] if x.upper() not in "no such rendering, TERM7"}


def test_models_beyond_any_limit(spark):
    """Ten thousand models too large and fifty that fit; every machine against all models."""
    rows = [(i, 1e12 + i) for i in range(10_000)] + [(20_000 + i, 1e9 + i * 3.3e8) for i in range(50)] + [(30_000, 1e9 + 49 * 3.3e8)]
    machines = [(i, i % 7 != 0, 4e9 + i * 1.7e9, 2e9 + (i * 7 % 40) * 1e9, (i % 3) * 2e9) for i in range(40)]
    m, k = spark.createDataFrame(rows, "model_id long, weights double"), spark.createDataFrame(machines, "machine_id long, silicon boolean, memory double, disk double, holding double")
    fits = lambda w, s, mem, disk, held: s and w * 1.4 + 3e9 + held <= mem * 0.75 and w + 1e9 <= disk
    want = {i: min(((-w, n) for n, w in rows if fits(w, *x)), default=(0, None))[1] for i, *x in machines}
    assert {r[0]: r[1] for r in catalogue.admitted(m, k).collect()} == want and sum(v is not None for v in want.values()) > 10
    told = one(spark, catalogue.obstacle(F.lit(True), F.lit(8e9), F.lit(1e12), F.lit(1e9), F.lit(2e9)))
    assert told == "both" and one(spark, catalogue.obstacle(F.lit(True), F.lit(64e9), F.lit(2e9), F.lit(1.5e9))) == "disk"


def test_long_answers_are_whole(spark):
    long = "x" * 1_200_000
    p = one(spark, profile.parsed_profile(F.lit(f"KIND: notice\nKIND: court notice\nBACKGROUND: b\nSUBJECT: {long}\nTERM: 甲 | A | B\nTERM: 甲 | C\nTERM: 乙 |\nNOTE: n")))
    assert len(p["subject"]) == 1_200_000 and p["kind"] == "court notice" and p["background"] == "b" and p["field"] == "law" and p["notes"] == ["n"]
    assert [(t["term"], t["rendering"]) for t in p["terms"]] == [("甲", "C")]
    assert one(spark, profile.parsed_names(F.lit(f"NAME: 甲 | {long}")))[0]["rendering"] == long
    assert len(one(spark, profile.parsed_questions(F.lit(f"QUESTION: {long}\nOPTION: a | b\nOPTION: c | {long}")))[0]["question"]) == 1_200_000
    v = [one(spark, profile.parsed_verdict(F.lit(t))) for t in ("VERDICT: ACCURATE", "verdict: revise", "REVISION:  ", "VERDICT: REVISE\nREVISION: better")]
    assert [(x["accurate"], x["revision"]) for x in v] == [(True, None), (False, None), (False, None), (False, "better")]


def test_document_answers(spark):
    answer = lambda sample, *a: one(spark, prompts.document_answers(F.lit(sample), *[F.lit(x).cast("string") for x in a]))
    ask = "QUESTION: q{}\nOPTION: a | b\nOPTION: c | d\n"
    full = answer("s" * 60, "KIND: court notice", "NAME: 甲 | A", "".join(ask.format(i) for i in range(5)))
    assert full["profile"]["field"] == "law" and [n["rendering"] for n in full["names"]] == ["A"] and [q["question"] for q in full["questions"]] == ["q0", "q1", "q2"]
    unknown = answer("s" * 60, None, None, "".join(ask.format(i) for i in range(5)))
    assert [q["question"] for q in unknown["questions"]] == [prompts.FIELD_QUESTION, "q0", "q1"] and unknown["names"] == []
    short = answer("s" * 50, "KIND: court notice", "NAME: 甲 | A", None)
    assert short["profile"]["kind"] == "" and short["names"] == [] and [q["question"] for q in short["questions"]] == [prompts.FIELD_QUESTION]
    assert answer("s" * 39, None, None, None)["questions"] == []


def test_prompts(spark):
    none, lines = F.array().cast("array<string>"), F.array(F.lit("x is so"), F.lit("y"))
    said = one(spark, prompts.translation_instructions("Chinese", "English", lines, none, "Pinyin"))
    assert "- x is so\n- y" in said and "Leave no Chinese" in said and "Pinyin" in said
    assert "above all else:\n- x is so" in one(spark, prompts.translation_instructions("Chinese", "English", F.lit(None).cast("array<string>"), lines))
    assert one(spark, prompts.adjudication_prompt(F.lit("b" * 300), F.lit("a1"), F.lit("a2"))).startswith("The block before it:\n" + "b" * 200 + "\n\nA: a1\n\nB: a2")
    assert one(spark, prompts.adjudication_prompt(F.lit(None).cast("string"), F.lit("p"), F.lit("q"))).startswith("A: p")
    terms = prompts.agreed_terms(F.array(F.struct(F.lit("甲").alias("term"), F.lit("A").alias("rendering"))), F.lit(None).cast("array<struct<source:string,rendering:string,basis:string>>"), integrity.literal_glossary([("乙", None), ("丙", "C")]))
    assert one(spark, terms) == ["“甲” is “A”.", "Keep “乙” as it is written.", "“丙” is “C”."]
    assert one(spark, prompts.translation_prompt(F.lit("t"), F.lit("heading"), F.lit("ctx\n"), terms)).endswith("- “丙” is “C”.\n\nTranslate this heading:\nt")
    for build in (prompts.transcription_instructions, prompts.transcription_prompt, prompts.adjudication_instructions):
        assert "Chinese" in one(spark, build("Chinese"))
    assert "UNKNOWN" in one(spark, prompts.names_instructions("Chinese", "English", lines, none)) and "REVISION:" in one(spark, prompts.review_instructions("Chinese", "English", lines, none, none))
    assert one(spark, prompts.review_prompt("Chinese", "English", F.lit("s"), F.lit("d"))) == "Chinese:\ns\n\nEnglish:\nd"
    assert "OPTION:" in one(spark, prompts.clarification_instructions("Chinese", "English")) and "TERM:" in one(spark, prompts.profile_instructions("Chinese", "English"))
    assert one(spark, prompts.sample_prompt(F.lit("s"))).endswith("\n\ns")
    image = one(spark, prompts.chat_request("openAICompatible", F.lit("m"), F.lit("s"), F.lit("u"), image=F.lit("QQ==")))
    assert '{"type":"image_url","image_url":{"url":"data:image/png;base64,QQ=="}}' in image
    assert '"images":["QQ=="]' in one(spark, prompts.chat_request("ollama", F.lit("m"), F.lit("s"), F.lit("u"), image=F.lit("QQ==")))


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page >> /Type/Page >>")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "c.PNG").write_bytes(b"png")
    (tmp_path / "d.txt").write_bytes(b"x")
    got = tables.opened(tables.files(spark, str(tmp_path)))
    assert sorted((r["path"][-5:], r["kind"], r["n_pages"], r["error"]) for r in got.collect()) == [("a.pdf", "pdf", 2, None), ("b.pdf", "pdf", 0, "no pages"), ("c.PNG", "image", 1, None), ("d.txt", None, 0, "unsupported: txt")]
    assert [(r["page"], r["has_layer"]) for r in tables.image_pages(got).collect()] == [(0, False)]
    model = tmp_path / "m" / "org" / "repo"
    model.mkdir(parents=True)
    (model / "w.safetensors").write_bytes(b"12345")
    (model / "c.json").write_bytes(b"12")
    assert [tuple(r) for r in tables.installed_models(spark, str(tmp_path / "m")).collect()] == [("org", "repo", 7, True)]


def test_export_edges(spark):
    cols = "doc_id int, page int, ord int, kind string, text string, source string, band string, reasons array<string>"
    b = spark.createDataFrame([(1, 0, 0, "paragraph", " \u3000\n", "x", "high", []), (1, 0, 1, "pageFurniture", "3 <", "x", "low", ["r"])], cols)
    d = spark.createDataFrame([(1, "a&b", 1, ["p"], "de", "en"), (2, "none", 0, [], "de", "en")], "doc_id int, name string, n_pages int, provenance array<string>, source_lang string, target_lang string")
    got = {r["doc_id"]: r["body"] for r in export.styled(b, d).collect()}
    assert got == {1: "# a&b\n\n> p\n\n*3 <*\n\n*⚠︎ Needs a human — r*\n\n", 2: "# none\n\n\n"}
    html = {r["doc_id"]: r["body"] for r in export.styled(b, d, "bilingual", "html").collect()}
    assert '<p class="furniture">3 &lt;</p>' in html[1] and "a&amp;b" in html[1] and html[2].endswith("</header>\n\n</body>\n</html>")
    assert [r["body"] for r in export.plain_text(b).collect()] == [] and [r["body"] for r in export.plain_text(b, furniture=True).collect()] == ["3 <\n"]


def test_standing_and_status(spark):
    held = spark.createDataFrame([("instruction", 1, None, None, "a"), ("term", 2, "t", None, None)], brief.BRIEF)
    assert [tuple(r) for r in brief.standing(held).collect()] == [(1, "a")]
    ready, blocked = brief.split_by_readiness(spark.createDataFrame([("e", "ready"), ("f", None), ("g", "unavailable")], "engine string, state string"))
    assert ready.count() == 1 and blocked.count() == 2
    assert [one(spark, export.stepped(F.lit(a), F.lit(d), F.lit(n))) for a, d, n in ((-1, 1, 5), (-1, -1, 5), (4, 1, 5), (0, -1, 5), (3, 1, 0))] == [0, 4, 0, 4, 3]
