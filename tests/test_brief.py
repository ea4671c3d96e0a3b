from pyspark.sql import functions as F

from quire.operators import brief, profile

SYLLABLES = {"布": "bu", "洛": "luo", "芬": "fen", "缓": "huan", "释": "shi", "王": "wang", "小": "xiao", "明": "ming"}


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_names(spark):
    answer = "NAME: 布洛芬 | ibuprofen | drug\nNAME: 布洛芬 | other\nNAME: 王小明 | Wang Xiaoming\nNAME: 甲 | UNKNOWN\nNAME: x\nNAME: 乙 | 乙\nNAME: 丙 | Bing Ltd |"
    got = [tuple(n) for n in one(spark, profile.parsed_names(F.lit(answer), SYLLABLES))]
    assert got == [("布洛芬", "ibuprofen", "drug"), ("丙", "Bing Ltd", None)]
    assert len(one(spark, profile.parsed_names(F.lit(answer)))) == 3
    assert [one(spark, profile.parsed_names(F.lit(x).cast("string"))) for x in (None, "", "None.\nNAME: a | b")] == [[], [], []]
    assert len(one(spark, profile.parsed_names(F.lit("\n".join(f"NAME: s{i} | r{i}" for i in range(30)))))) == 20


def test_questions(spark):
    answer = "OPTION: lost | x\nQUESTION: Which party?\nBECAUSE: line 2\nOPTION: buyer | says buyer | twice\nOPTION: seller | says seller\nOPTION: bad\nQUESTION: One option?\nOPTION: a | b\nQUESTION:\nOPTION: a | b\nOPTION: c | d"
    got = one(spark, profile.parsed_questions(F.lit(answer)))
    assert [(q["question"], q["evidence"], [o["label"] for o in q["options"]]) for q in got] == [("Which party?", "line 2", ["buyer", "seller", "Not sure"])]
    assert got[0]["options"][0]["guidance"] == "says buyer | twice"
    assert [one(spark, profile.parsed_questions(F.lit(x).cast("string"))) for x in (None, "", "NONE")] == [[], [], []]


def test_transliterated(spark):
    assert brief.spelled_names("服布洛芬缓释片", "Take Buluofen tablets", SYLLABLES) == []  # a character outside the map
    assert brief.spelled_names("布洛芬缓释", "Take Buluofen tablets", SYLLABLES) == [("布洛芬", "Buluofen")]
    assert brief.spelled_names("布洛芬缓释", "Buluofenhuanshi, Buluofen", SYLLABLES) == [("布洛芬缓释", "Buluofenhuanshi")]
    assert brief.spelled_names("王小明", "Wangxiaoming", SYLLABLES, ["Wang Xiaoming"]) == []
    assert brief.spelled_names(None, None, SYLLABLES) == []
    df = spark.createDataFrame([("布洛芬", "Buluofen"), (None, None)], "s string, t string")
    assert [[f["evidence"] for f in r[0]] for r in df.select(brief.transliterated(F.col("s"), F.col("t"), SYLLABLES)).collect()] == [["Buluofen"], []]


def test_brief(spark):
    g = spark.createDataFrame([("甲方", "Party A")], "term string, rendering string")
    more = brief.with_term(brief.with_term(g, " 乙方 ", "Party B"), "  ", "x")
    assert sorted(r["term"] for r in more.collect()) == ["乙方", "甲方"]
    assert [r["term"] for r in brief.without_term(more, "甲方").collect()] == ["乙方"]
    requests, answers = spark.createDataFrame([(1,), (2,)], "request_id int"), spark.createDataFrame([(2, "b"), (9, "z"), (2, "c")], "request_id int, answer string")
    assert sorted(map(tuple, brief.answered(requests, answers).collect())) == [(1, ""), (2, "b")]
    status = spark.createDataFrame([("a", "reader", "ready"), ("a", "reviewer", "ready"), ("b", "reader", "ready"), ("b", "translator", "unavailable")], "scope string, role string, state string")
    assert {r["scope"]: r["ready"] for r in brief.can_translate(status, ["scope"]).collect()} == {"a": True, "b": False}
    guide = brief.guidance(F.lit("notice"), F.lit("unknown"), F.lit(None).cast("string"), F.lit("formal"), F.array(F.lit("old")))
    assert one(spark, guide) == "Kind: notice\nRegister: formal\nNote: old"
