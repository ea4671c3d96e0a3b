"""Han texts by hand: readings, list marks, shares, findings, and Latin readings by whole runs."""

from pyspark.sql import functions as F

from quire.functions import romanize
from quire.functions import text as T
from quire.functions.pack import CHINESE
from quire.operators import brief, integrity, profile

#: Readings with blanks, full-width forms and other white space, by number.
HAN = [
    (1, "中 国　合 同"), (2, "　　ab"), (3, "第 3 页"), (4, "甲方\t乙方"), (5, "１、总则"), (6, "（一） 定义"), (7, "第十条 付款"), (8, "  ABC 中  文 def　 "), (9, "　"), (10, "共１０，０００元"), (11, "二、范围"), (12, "· 项目"), (13, "正文。"),
    (14, "“你好”！"), (15, "12) item"), (16, "a　中 b"), (17, ""), (18, "カタカナ"), (19, "— 甲 —"), (20, "٣. item"),
]
#: (source, target) pairs and what is found in them.
HAN_PAIRS = [
    (1, "于2024年签署的合同", "Signed in 2023, the contract", "droppedNumber:3:2024,inventedNumber:2:2023"), (2, "共１０，０００元整的款项", "a total of 10,000 yuan in all", ""), (3, "有文字", "　 ", "emptyTranslation:3:"), (4, "　", "x", ""),
    (5, "第3章和第2节的内容", "the second section of chapter three", ""), (6, "共5000元整的款项在此", "five thousand yuan in total", "droppedNumber:3:5000"), (7, "签署于5月的合同文本", "A contract signed in May by both", ""), (8, "二〇二四年签署的合同", "The contract was signed in 2024", ""),
    (9, "很长的中文句子在这里", "很长的中文句子在这里", "echoedSource:3:很长的中文句子在这里,untranslatedScript:3:很长的中文句子在这里"), (10, "这是一个很长的句子", "go on go on go on go on go on", "repeatedRun:3:go on"), (11, "这是一个很长的句子", "Note: this is a long sentence", "leakedInstruction:2:Note:"),
    (12, "甲方应当付款给乙方", "The buyer shall pay the seller", "briefIgnored:3:Party A,inconsistentTerm:2:Party B"), (13, "甲方应当付款给乙方", "Party A shall pay party b now", ""), (14, "这是一个很长的句子", "a b", "lengthOutOfRange:2:"), (15, "这是一个很长的句子", "this " * 20 + "is long", "lengthOutOfRange:1:,repeatedRun:3:this"),
    (16, "服用布洛芬缓释", "Take Buluofen now, as told", "transliteratedName:2:Buluofen"), (17, "条款在这里", "a clause 条款在 here", "untranslatedScript:2:条款在"),
]
SYLLABLES = {"服": "fu", "用": "yong", "布": "bu", "洛": "luo", "芬": "fen", "缓": "huan", "释": "shi"}
NORMAL = {1: "中国合同", 2: "ab", 3: "第 3 页", 4: "甲方\t乙方", 8: "ABC 中文 def", 9: "", 10: "共１０，０００元", 16: "a 中 b", 6: "（一）定义", 7: "第十条付款", 12: "· 项目", 19: "— 甲 —"}


def test_readings(spark):
    h = spark.createDataFrame(HAN, "id int, text string")
    got = {r["id"]: r for r in h.select("id", T.normalized(F.col("text"), CHINESE).alias("n"), T.list_item(T.trimmed(F.col("text"))).alias("item"), T.script_share(F.col("text"), CHINESE).alias("share")).collect()}
    assert {i: r["n"] for i, r in got.items()} == {i: NORMAL.get(i, t) for i, t in HAN}
    assert {i for i, r in got.items() if r["item"]} == {5, 6, 7, 11, 12, 15, 19, 20}
    assert round(got[8]["share"], 6) == 0.25 and got[17]["share"] == 0


def test_findings(spark):
    h = spark.createDataFrame([r[:3] for r in HAN_PAIRS], "id int, source string, target string").withColumn("names", brief.transliterated(F.col("source"), F.col("target"), SYLLABLES))
    found = integrity.findings(F.col("source"), F.col("target"), CHINESE, [("甲方", "Party A")], {"乙方": "Party B", "甲方": "x"}, F.col("names"))
    tags = F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["severity"].cast("string"), F.coalesce(f["evidence"], F.lit("")))), ",")
    assert {r["id"]: r["t"] for r in h.select("id", tags.alias("t")).collect()} == {i: f for i, _, _, f in HAN_PAIRS}


def test_readings_by_runs(spark):
    known = romanize.readings(spark)
    read = romanize.Reader(known)
    assert len(known) > 20_000
    assert read("布洛芬") == ["bu", "luo", "fen"] and read("重庆") == ["chong", "qing"] and read("重要") == ["zhong", "yao"] and read("秘鲁重") == ["bi", "lu", "zhong"]
    assert read("布x") is None and read("") is None
    own = romanize.Reader(known | {"银行": "yin hang"})
    assert own("银行行走") == ["yin", "hang", "xing", "zou"]
    theirs = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; NFD; [:M:] Remove; NFC")
    for run in ("甲方应当付款给乙方", "藏文重庆秘鲁", "中华人民共和国最高人民法院", "文藏庆重鲁秘"):
        assert read(run) == theirs.transliterate(run).lower().split()
    df = spark.createDataFrame([(1, "布洛芬缓释", "Buluofenhuanshi"), (2, "重庆市", "Zhongqingshi"), (3, "重庆市", "chongqingshi"), (4, None, "x"), (5, "布洛芬", None)], "id int, s string, t string")
    got = {r["id"]: [f["evidence"] for f in r["f"]] for r in df.select("id", brief.transliterated(F.col("s"), F.col("t"), known).alias("f")).collect()}
    assert got == {1: ["Buluofenhuanshi"], 2: [], 3: ["chongqingshi"], 4: [], 5: []}
    names = spark.range(1).select(profile.parsed_names(F.lit("NAME: 布洛芬 | Bu-luo-fen\nNAME: 布洛芬 | ibuprofen | a drug\nNAME: 重庆 | Chongqing"), known).alias("n")).first()["n"]
    assert [n["rendering"] for n in names] == ["ibuprofen"]


def test_a_run_is_read_once_a_batch():
    import pyarrow as pa

    class Counted(romanize.Reader):
        asked = 0

        def __call__(self, run):
            Counted.asked += 1
            return super().__call__(run)

    got = Counted(SYLLABLES).column(pa.array(["服用", None, "布", "", "服用", "甲", "布"])).to_pylist()
    assert got == [["fu", "yong"], None, ["bu"], None, ["fu", "yong"], None, ["bu"]] and Counted.asked == 3
