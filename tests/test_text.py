from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.pack import CHINESE, DIACRITIC
from quire.operators import catalogue, context, integrity, layout, profile, reconcile, translate
from quire.streaming import ledger


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return row.select(expr).first()[0]


def test_number_runs(spark):
    assert one(spark, T.number_runs(F.col("t")), t="共１０，０００元 and 10,000. Then 3.5, 7") == ["10000", "10000", "3.5", "7"]
    assert one(spark, T.multiset_minus(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "ab")))) == ["a"]


def kinds(spark, source, target, pack=CHINESE, **kw):
    return [(f["kind"], f["severity"], f["evidence"]) for f in one(spark, integrity.findings(F.col("s"), F.col("t"), pack, **kw), s=source, t=target)]


def test_findings(spark):
    assert kinds(spark, "", "x") == []
    assert kinds(spark, "有文字", "  ") == [("emptyTranslation", 3, None)]
    assert ("droppedNumber", 3, "2024") in kinds(spark, "于2024年签署的合同", "Signed in 2023, the contract")
    assert ("inventedNumber", 2, "2023") in kinds(spark, "于2024年签署的合同", "Signed in 2023, the contract")
    assert kinds(spark, "共１０，０００元整的款项", "a total of 10,000 yuan in all") == []
    assert kinds(spark, "第3章和第2节的内容", "the second section of chapter three") == []
    assert ("droppedNumber", 3, "5000") in kinds(spark, "共5000元整的款项在此", "five thousand yuan in total")
    assert kinds(spark, "签署于5月的合同文本", "A contract signed in May by both") == []
    assert kinds(spark, "二〇二四年签署的合同", "The contract was signed in 2024") == []
    assert ("repeatedRun", 3, "go on") in kinds(spark, "这是一个很长的句子", "go on go on go on go on go on")
    assert ("leakedInstruction", 2, "note:") in [(k, s, e.lower() if e else e) for k, s, e in kinds(spark, "这是一个很长的句子", "Note: this is a long sentence")]
    assert ("briefIgnored", 3, "Party A") in kinds(spark, "甲方应当付款给乙方", "The buyer shall pay the seller", glossary=[("甲方", "Party A")])
    assert ("inconsistentTerm", 2, "Party B") in kinds(spark, "甲方应当付款给乙方", "Party A shall pay the seller", glossary=[("甲方", "Party A")], terms={"乙方": "Party B", "甲方": "x"})
    assert kinds(spark, "很长的中文句子在这里", "很长的中文句子在这里")[0][0] == "echoedSource"


def test_written_forms(spark):
    assert one(spark, T.written_forms(F.lit("20"))) == ["二〇", "二十"]
    assert one(spark, T.written_forms(F.lit("2024"))) == ["二〇二四"]


def test_similarity_and_median(spark):
    assert one(spark, T.similarity(F.lit(""), F.lit(""))) == 1
    assert one(spark, T.similarity(F.lit("x"), F.lit(""))) == 0
    assert 0.85 < one(spark, T.similarity(F.lit("abcdefghijklm"), F.lit("abcdefghijkxm"))) < 1
    assert one(spark, T.upper_median(F.array(*map(F.lit, [0, 1, 2, 3])))) == 2
    d = one(spark, T.differing(F.lit("total 45 mg"), F.lit("total 46 mg")))
    assert (d["left"], d["right"]) == ("5", "6")


def test_normalized(spark):
    assert one(spark, T.normalized(F.lit(" 中 文  Latin text 字 "), CHINESE)) == "中文 Latin text 字"
    assert one(spark, T.script_share(F.lit("汉字"), CHINESE)) == 1
    assert one(spark, T.script_share(F.lit("none"), CHINESE)) == 0


def test_confidence(spark):
    none = F.array().cast("array<struct<kind:string,severity:int,evidence:string>>")
    bad = F.array(F.struct(F.lit("x").alias("kind"), F.lit(3).alias("severity"), F.lit("").alias("evidence")))
    score = lambda found, **k: one(spark, integrity.confidence(F.lit(k.get("how", "unanimous")), F.lit("visionOCR"), F.lit(None).cast("double"), found, F.lit(0.9), F.lit(True), F.lit(False)))
    assert score(none) == 1
    assert score(bad) == 0.35
    assert abs(score(none, how="defaulted") - 0.7) < 1e-9
    assert [one(spark, integrity.band(F.lit(x))) for x in (0.95, 0.7, 0.2)] == ["high", "check", "low"]


def test_sentences():
    cut = lambda t, p=CHINESE: [t[a:b] for a, b in layout.sentence_spans(t, p)]
    assert cut("第一句。第二句！”第三") == ["第一句。", "第二句！”", "第三"]
    assert cut("See No. 5 of Co. Ltd. today. Then 3.5 more. End") == ["See No. 5 of Co. Ltd. today.", "Then 3.5 more.", "End"]
    assert cut("") == []


def lines(spark, rows):
    return spark.createDataFrame([("d", 0, i, f"line {i} of a page, long enough", 0.9, *b) for i, b in enumerate(rows)], "doc_id string, page int, line_no int, text string, confidence double, x double, y double, w double, h double")


def test_layout(spark):
    two = lines(spark, [(x, 0.1 + 0.03 * i, 0.36, 0.02) for i in range(5) for x in (0.06, 0.56)])
    assert layout.gutters(two).count() == 1
    assert [r["line_no"] for r in layout.reading_order(two).sort("ord").collect()] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    assert layout.gutters(lines(spark, [(0.06, 0.1 * i, 0.88, 0.02) for i in range(6)])).count() == 0
    assert layout.blocks(lines(spark, [(0.1, 0.10, 0.8, 0.02), (0.1, 0.13, 0.8, 0.02)]), DIACRITIC).count() == 1
    assert layout.blocks(lines(spark, [(0.1, 0.10, 0.8, 0.02), (0.1, 0.30, 0.8, 0.02)]), DIACRITIC).count() == 2


def test_alignment():
    s = ["the first sentence here.", "a second one follows it.", "then comes a third now.", "and the fourth is last."]
    pairs = reconcile.align_texts(s, s)
    assert len(pairs) == 4 and all(p[2] == 1 for p in pairs)
    assert [(len(a), len(b)) for a, b, _ in reconcile.align_texts(["".join(s)], s)] == [(1, 4)]
    assert [(len(a), len(b)) for a, b, _ in reconcile.align_texts(s, ["".join(s)])] == [(4, 1)]
    assert [(len(a), len(b)) for a, b, _ in reconcile.align_texts(s, [s[0], *s[2:]])] == [(1, 1), (1, 0), (1, 1), (1, 1)]
    assert all(not (len(a) and len(b)) for a, b, _ in reconcile.align_texts(["abcdef"], ["uvwxyz"]))
    assert reconcile.align_texts([], ["x"]) == [(range(0, 0), range(0, 1), 0.0)]


def test_reconcile(spark):
    assert one(spark, reconcile.without_repeats(F.array(F.lit("abcdefghijklmnop"), F.lit("abcdefghijklmnoq"), F.lit("other")))) == ["abcdefghijklmnop", "other"]
    settle = lambda a, b, s, answer: one(spark, reconcile.settle(F.lit(a), F.lit(b), F.lit(s), F.lit(False), F.lit(True), F.lit(answer).cast("string"), DIACRITIC))
    assert tuple(settle("", "x", 0.0, None)) == ("x", 0.0, "single")
    assert tuple(settle("x", "", 0.0, None)) == ("x", None, "single")
    assert tuple(settle("total 45", "total 46", 0.9, "B")) == ("total 45", 0.9, "defaulted")
    assert tuple(settle("totel 45", "total 45", 0.9, "B because")) == ("total 45", 0.9, "adjudicated")


def test_profile(spark):
    pages = lambda n, k: one(spark, profile.survey_pages(F.lit(n), k))
    assert [pages(20, 2), pages(4, 12), pages(1, 12), pages(20, 1)] == [[10, 19], [1, 2, 3], [], [19]]
    assert [one(spark, profile.field(F.lit(t))) for t in ("a hospital document", "court notice", "zzz")] == ["medicine", "law", "unknown"]
    p = one(spark, profile.parsed_profile(F.lit("KIND: court notice\nSUBJECT: a loan\nTERM: 甲方 | Party A\nTERM: bad\nNOTE: old")))
    assert (p["field"], [(t["term"], t["rendering"]) for t in p["terms"]], p["notes"]) == ("law", [("甲方", "Party A")], ["old"])
    assert one(spark, profile.parsed_verdict(F.lit("VERDICT: REVISE\nRevision: better")))["revision"] == "better"
    assert one(spark, profile.parsed_verdict(F.lit("fine")))["accurate"]
    assert one(spark, profile.cleaned_answer(F.lit("<think>hm</think>\n```text\nyes\n```"))) == "yes"


def test_context(spark):
    rows = [("d", 0, 0, "heading", "H", "h"), ("d", 0, 1, "pageFurniture", "1", None), ("d", 0, 2, "paragraph", "A.", "a"), ("d", 1, 0, "paragraph", "B", "b")]
    got = context.neighbours(spark.createDataFrame(rows, "doc_id string, page int, ord int, kind string, text string, target string")).sort("page", "ord").collect()
    assert [r["next_source"] for r in got] == ["A.", "A.", None, None]
    assert [r["previous_source"] for r in got] == [None, "H", "H", "A."]
    assert got[3]["section_heading"] == "h"


def test_translated(spark):
    rows = [("paragraph", "中文", "ctx"), ("pageFurniture", "中文", None), ("paragraph", "4 mg/L", None), ("paragraph", "坏", None), ("paragraph", "又是", "ctx"), ("paragraph", "共5元", None)]
    df = spark.createDataFrame(rows, "kind string, text string, context string")
    df = df.withColumns({"context_reasons": F.array(F.lit("near")), "settlement": F.lit("unanimous"), "reader": F.lit("visionOCR"), "because": F.lit(None).cast("string"), "agreement": F.lit(1.0)})

    def engine(text, ctx):
        if text == "坏":
            raise ValueError("no")
        return text if ctx or text == "又是" else "Chinese"

    def review(text, draft):
        return "VERDICT: REVISE\nREVISION: five yuan" if text == "共5元" else "VERDICT: ACCURATE"

    second = lambda text, ctx: 1 / 0 if text == "中文" else "Chinese"
    got = translate.translated(df, engine, second, review, CHINESE).collect()
    assert [(r["first_draft"], r["copied"], r["retried_alone"], r["error"]) for r in got] == [("Chinese", False, True, None), ("中文", True, False, None), ("4 mg/L", True, False, None), ("", False, False, "no"), ("又是", False, False, None), ("Chinese", False, False, None)]
    assert [r["shown"] for r in got][-1] == "five yuan" and got[-1]["was_revised"] and got[0]["context_reasons"] == [context.ALONE]
    assert [f["kind"] for f in got[3]["findings"]] == ["emptyTranslation"] and got[3]["score"] == 0 and got[3]["reasons"] == ["no"] and got[1]["score"] == 1
    assert got[0]["reasons"][:2] == ["Both readers agree", "One translator only"] and abs(got[0]["score"] - 0.95) < 1e-9
    assert [f["kind"] for f in got[4]["findings"]][:2] == ["echoedSource", "untranslatedScript"] and got[4]["score"] <= 0.35
    assert translate.translated(df.limit(0), engine, None, None, CHINESE).count() == 0


def test_ledger(spark):
    cols = "scope int, purpose string, authority string, outcome string, bytes_sent long, bytes_received long"
    rows = [(1, "modelWeights", "hub.example.org", "allowed", 1, 10), (2, "documentWork", "x.example.org", "refused", 0, 0)]
    got = {r["scope"]: r for r in ledger.totals(spark.createDataFrame(rows, cols), ["scope"]).collect()}
    assert (got[1]["stayed"], got[1]["documents_stayed"]) == (False, True)
    assert (got[2]["documents_stayed"], got[2]["refusals"]) == (True, 1)
    ok = lambda a: one(spark, ledger.admitted_endpoint(F.lit(a)))
    assert [ok("localhost:80"), ok("127.0.0.1"), ok("[::1]:8080"), ok("example.org:80"), ok("127.0.0.1:0"), ok("127.0.0.256")] == ["127.0.0.1:80", "127.0.0.1", "[::1]:8080", None, None, None]


def test_progress_stream(spark, tmp_path):
    """The stream's state, its batch twin and the plain fold say the same."""
    events = [("started", 2, 0), ("pageStarted", 0, 2), ("readerFinished", 9, 1), ("pageReconciled", 3, 1), ("blockTranslated", 0, 3), ("pageStarted", 1, 2), ("pageReconciled", 4, 2), ("blockTranslated", 2, 4)]
    rows = [(1, i, *e) for i, e in enumerate(events)]
    cols = "job long, seq long, event string, value long, of long"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    q = ledger.progress_stream(stream).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    state = (0, 0, 0, 0, 0, False)
    for e in events:
        state = ledger.fold(state, *e)
    assert state == (2, 1, 4, 3, 3, False)
    assert tuple(spark.sql("select * from progress").collect()[-1]) == (1, *state, 0.875)
    assert tuple(ledger.progress(spark.createDataFrame(rows, cols)).first()) == (1, *state, 0.875)
    open(tmp_path / "x.ndjson", "w").write('{"a": 1}\n{broken\n')
    q = ledger.read_lines(spark, str(tmp_path / "*.ndjson"), "a int").writeStream.format("memory").queryName("nd").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["bytes"], r["fields"]["a"] if r["fields"] else None) for r in spark.sql("select * from nd").collect()) == [(7, None), (8, 1)]


def test_catalogue(spark):
    models = spark.createDataFrame([(1, 1.4e9), (2, 2.3e9), (3, 18.5e9)], "model_id long, weights double")
    machines = spark.createDataFrame([(1, True, 8.6e9, 1e12), (2, False, 6.4e10, 1e12), (3, True, 6.4e10, 1e12)], "machine_id long, silicon boolean, memory double, disk double")
    assert {r[0]: r[1] for r in catalogue.admitted(models, machines).collect()} == {1: 2, 2: None, 3: 3}
