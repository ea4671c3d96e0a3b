"""Exports as files: written, read back, failures as rows, and nothing left of a run that fails."""

import os

import pytest
from pyspark.sql import functions as F

from quire.sources import exports

ROWS = "doc_id string, name string, body string"


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("1", "a-en.txt", "Körper\n"), ("2", "a-en.txt", ""), (None, "b.md", None), ("x/../y", "c.html", "c"), ("1", "a-en.txt", "twice"), ("3", "n" * 300, "x"), ("4", "../up", "x"), ("5", None, "x"), ("6", "", "x")]
    exports.write(spark.createDataFrame(rows, ROWS).coalesce(1), path)
    got = sorted((tuple(r) for r in exports.read(spark, path).collect()), key=repr)
    assert got == sorted([("1", "a-en.txt", "Körper\n"), ("2", "a-en.txt", ""), (None, "b.md", ""), ("x/../y", "c.html", "c")], key=repr)
    told = {(r["doc_id"], r["name"], r["bytes"]): r["error"] for r in exports.outcomes(spark, path).collect()}
    assert len(told) == len(rows) and sum(e is not None for e in told.values()) == 5
    assert "already" in told["1", "a-en.txt", None] and told["1", "a-en.txt", 8] is None
    assert sorted(os.listdir(path)) == [f for f in sorted(os.listdir(path)) if f.startswith("part-")]
    exports.write(spark.createDataFrame([("9", "z.txt", "z")], ROWS), path)
    assert exports.read(spark, path).count() == 5
    exports.write(spark.createDataFrame([("9", "z.txt", "new")], ROWS).coalesce(1), path, "overwrite")
    assert [tuple(r) for r in exports.read(spark, path).collect()] == [("9", "z.txt", "new")]


def test_failed_run_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(str(i), f"{i}.txt", "x") for i in range(40)], ROWS).repartition(4)
    broken = rows.withColumn("body", F.when(F.col("doc_id") == "7", F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="boom"):
        exports.write(broken, path)
    assert not [f for _, _, fs in os.walk(path) for f in fs]
    assert exports.read(spark, path).count() == 0
    exports.write(rows.limit(0), path)
    assert exports.read(spark, path).count() == 0


def test_styled_pages_by_one_shuffle(spark):
    from quire.operators import export

    blocks = spark.createDataFrame([("a", 1, 1, "second"), ("a", 1, 0, "first"), ("a", 9, 0, "beyond"), ("a", None, 0, "nowhere"), ("b", 0, 0, "only"), ("z", 0, 0, "of no document")], "doc_id string, page int, ord int, text string")
    blocks = blocks.withColumns({"kind": F.lit("paragraph"), "source": F.col("text"), "band": F.lit("high"), "reasons": F.array().cast("array<string>")})
    docs = spark.createDataFrame([("a", 4), ("b", 1), ("c", 2), ("d", 0)], "doc_id string, n_pages int").withColumns({"name": F.lit("n"), "provenance": F.array().cast("array<string>"), "source_lang": F.lit("de"), "target_lang": F.lit("en")})
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        df = export.styled(blocks, docs)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
        got = {r["doc_id"]: r["body"].removeprefix("# n\n\n\n") for r in df.collect()}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    page = [f"## Page {k}\n\n" for k in range(5)]
    assert got == {"a": page[1] + page[2] + "first\n\nsecond\n\n" + page[3] + page[4], "b": "only\n\n", "c": page[1] + page[2], "d": ""}
