"""Shortcuts of the checks give what the whole way gives."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.pack import CHINESE, DIACRITIC
from quire.operators import export, translate
from quire.operators.reconcile import _distance


def test_similarity_of_texts_that_hold_one_another(spark):
    """Texts of which the one holds the other take no table of distances; the result is the distance's, nulls included."""
    rows = [("", ""), ("", "a"), ("abc", "abc"), ("abc", "xabcy"), ("Übung", "bun"), ("abcd", "abxd"), ("a" * 9, "b" * 3), (None, "a"), ("a", None), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    n = F.greatest(F.char_length("a"), F.char_length("b"))
    whole = F.when(n == 0, 1.0).when((F.col("a") == "") | (F.col("b") == ""), 0.0).otherwise(1 - F.levenshtein("a", "b") / n)
    assert df.where(~T.similarity(F.col("a"), F.col("b")).eqNullSafe(whole)).count() == 0


def test_checks_by_shortcut(spark):
    """Echoes, figures as words, leaks and phrases said again, where a text's letters, case and width are odd."""
    df = spark.createDataFrame([("Ein Text in kleiner Schrift, der gleich bleibt.", "EIN TEXT IN KLEINER SCHRIFT, DER GLEICH BLEIBT."), ("Ein Text in kleiner Schrift, der gleich bleibt.", "Ein Text in kleiner Schrift, der gleich bliebt."), ("eaieaieaie", "eaieaieai")], "a string, b string")
    assert [r[0] for r in df.select(T.echoes(F.col("a"), F.col("b"))).collect()] == [False, True, False]
    leaks = ["As an AI model", "as an aİ", "NOTE: x", "so it TRANSLATES TO y", "first\ntranslates to", "here İs the translation", "plain"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(leaks)], "i int, t string").sort("i").select(T.instruction_leak(F.col("t"))).collect()]
    assert got == ["As an AI", "as an aİ", "NOTE:", "translates to", None, None, None]
    said = ["a b c d e f g h", "x x x x e f g h", "u a b a b a b a b v", "a b a c a d a e", "x x x x e f g"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").sort("i").select(T.repeated_run(F.col("t"))).collect()]
    assert got == [None, "x", "a b", None, None]
    texts = spark.createDataFrame([(t,) for t in ("", "plain", "Stück", "。，", "漢", "×÷ é!", "a　b", "…é…")], "t string")
    for pack in (CHINESE, DIACRITIC):
        assert texts.where(T.holds_script(F.col("t"), pack) != (T.script_share(F.col("t"), pack) > 0)).count() == 0
    wide = spark.createDataFrame([("１，２３４．５０ and 7.",)], "t string").select(T.number_runs(F.col("t"))).collect()[0][0]
    assert wide == ["1234.50", "7"]


def test_blocks_that_are_not_asked_are_dealt(spark):
    """Blocks without a question have no key to meet their answer by; they must not all come to one task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        none = F.lit(None).cast("string")
        b = spark.range(400).select("id", F.lit("paragraph").alias("kind"), F.concat(F.lit("plain "), F.col("id").cast("string")).alias("text"), F.lit("single").alias("settlement"), F.lit("visionOCR").alias("reader"), none.alias("because"), F.lit(None).cast("double").alias("agreement"))
        t = translate.translated_in_batches(b, lambda asked: asked, lambda asked: asked, DIACRITIC)
        each = [r["n"] for r in t.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(each) == 400 and max(each) < 200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cursors_stand_where_a_sorted_queue_has_them(spark):
    """Scores that tie or are null, several cursors of a queue, wrapping ones and ones without a queue; the queue is worked out once."""
    seen = spark.sparkContext.accumulator(0)

    def made(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = [(g, None if i % 11 == 5 else (i * 7 % 4) / 4, i % 5, i) for g in (1, 2) for i in range(60 + g)]
    queue = spark.createDataFrame(rows, "group int, score double, page int, ord int").mapInPandas(made, "group int, score double, page int, ord int")
    at = [(1, 0), (1, 60), (1, 61), (1, 1000), (2, 7), (2, 7), (2, -1), (3, 4)]
    got = export.queue_target(queue, spark.createDataFrame(at, "group int, at int"), ["group"]).select("group", "at", "score", "page", "ord", "of").collect()
    of = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])) for g in (1, 2)}
    want = [(g, n, *of[g][n % len(of[g])][1:], len(of[g])) for g, n in at if g in of and n >= 0]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert seen.value == len(rows)


def test_exported_files_are_read_in_small_batches(tmp_path):
    """A task that reads files holds a few hundred, or a few long ones, at a time."""
    import pyarrow as pa

    from quire.sources import exports

    rows = [(str(i), "a.txt", "é" * 900_000 if i >= 600 else f"text {i}") for i in range(610)]
    w = exports._Writer(str(tmp_path / "out"), False)
    w.commit([w.write(iter([pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["doc_id", "name", "body"])]))])
    reader = exports._Reader(str(tmp_path / "out"))
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows <= exports.HELD and sum(map(len, b.column("body").to_pylist())) < exports.MOST + 900_000 for b in got)
    assert sorted(r for b in got for r in zip(*[c.to_pylist() for c in b.columns], strict=True)) == sorted(rows)


def test_whole_texts_are_compared(spark):
    """What differs beyond the first two thousand characters counts, in a likeness and in a translation that echoes its source."""
    r = random.Random(6)
    a, b, c, d = ("".join(r.choice("etaoin shrdlu") for _ in range(2500)) for _ in range(4))
    # a tenth of the whole, and one edit less, all beyond the beginning
    tenth = a + "#" * 249 + b[249:2499]
    rows = [(a + b, a + c), (a + b, a + b[:2000] + d[:100]), (a + b[:2499], tenth), (a + b[:2499], tenth[:2748] + b[248:2499]), (a[:2000] + b, c[:2000] + b), (a + b, "x" + a + b), ("é" * 3000 + a, "é" * 3000 + b)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string").sort("i")
    want = [1 - _distance(x, y) / max(len(x), len(y)) for x, y in rows]
    assert [x[0] for x in df.select(T.similarity(F.col("a"), F.col("b"))).collect()] == want
    assert [x[0] for x in df.select(T.echoes(F.col("a"), F.col("b"))).collect()] == [w > 0.9 for w in want] and {w > 0.9 for w in want} == {True, False}
    none = F.lit(None).cast("string")
    t = spark.createDataFrame([("ü" + a + b,)], "text string").select("text", F.lit("paragraph").alias("kind"), none.alias("context"), F.array().cast("array<string>").alias("context_reasons"), F.lit("single").alias("settlement"), F.lit("visionOCR").alias("reader"), none.alias("because"), F.lit(None).cast("double").alias("agreement"))
    end = d * 2
    found = translate.translated(t, lambda text, context: text[:2500] + end[: len(text) - 2500], None, None, DIACRITIC).collect()[0]["findings"]
    assert "echoedSource" not in [f["kind"] for f in found]


def test_likeness_told_by_counts(spark):
    """What counts and places tell of two texts is what their distance tells, around a tenth of edits, with letters of every width."""
    r = random.Random(8)
    rows = []
    for n in (1, 9, 10, 11, 30, 100, 101, 300):
        for kind in ("etaoin", "ETAOIN é", "aÉ漢𝔘 x"):
            for share in (0.0, 0.09, 0.1, 0.12, 0.2, 0.4):
                for how in ("in place", "anywhere", "at the end", "capitals"):
                    x = [r.choice(kind) for _ in range(n)]
                    y = [*x]
                    for at in r.sample(range(n), int(n * share)):
                        y[at] = y[at].upper() if how == "capitals" else r.choice("Xü𝔅") if how == "in place" else y[at]
                    for _ in range(int(n * share) if how in ("anywhere", "at the end") else 0):
                        at = r.randrange(len(y) + 1) if how == "anywhere" else len(y)
                        y[at : at + r.choice([0, 1])] = [r.choice("Xü𝔅"), ""][: r.choice([1, 2])][-1:]
                    rows.append(("".join(x), "".join(y)))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string").sort("i")
    want = [1 - _distance(x, y) / max(len(x), len(y)) > 0.9 for x, y in rows]
    assert [x[0] for x in df.select(T.echoes(F.col("a"), F.col("b"))).collect()] == want and 100 < sum(want) < len(want) - 100
    assert [x[0] for x in df.select(T.echoes(F.col("b"), F.col("a"))).collect()] == want
