"""Steps whose work must not grow with the square of a table."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalogue, integrity, profile


def test_admission_of_many_equal_models(spark):
    """Machines that could hold a million equal models, and limits that are met to the last bit."""
    n = 600_000
    m = spark.range(n).select((F.col("id") + 5).alias("model_id"), (F.lit(1e9) * (F.col("id") % 3 + 14)).alias("weights"))
    k = spark.range(20_000).select(F.col("id").alias("machine_id"), (F.col("id") % 4 != 0).alias("silicon"), F.lit(3.2e10).alias("memory"), F.when(F.col("id") % 2 == 0, 1.6e10).otherwise(1.6e10 - 1e-5).alias("disk"))
    got = catalogue.admitted(m, k)
    assert {tuple(r) for r in got.groupBy("model_id").count().collect()} == {(None, 5_000), (5, 10_000), (6, 5_000)}
    tight = spark.createDataFrame([(1, True, 1e15, 1.6e10 + 1e9), (2, True, 1e15, 1.6e10 + 1e9 - 1e-5), (3, True, (1.4 * 1.5e10 + 3e9) / 0.75, 1e15)], "machine_id int, silicon boolean, memory double, disk double")
    assert {r[0]: r[1] for r in catalogue.admitted(m, tight).collect()} == {1: 7, 2: 6, 3: 6}


def test_figures_that_stand_in_both_are_not_invented(spark):
    """A figure that the target holds as the source does, whose word happens to stand in another word of the target."""
    rows = [("one 1 stone", "ONE 1 STONE!", "", ""), ("1 and 3", "1 and three", "", ""), ("in 1", "stone 1 1", "", "1"), ("5月5日", "5 May", "", ""), ("2 2", "2", "2", ""), ("１０ of 7", "7 of 10", "", ""), (" a 8 ", "8 a", "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string, dropped string, invented string")
    got = df.select("i", "dropped", "invented", integrity.number_differences(F.col("s"), F.col("t")).alias("d")).select("i", (F.array_join("d.dropped", ",") == F.col("dropped")).alias("a"), (F.array_join("d.invented", ",") == F.col("invented")).alias("b"))
    assert [tuple(r) for r in got.where("not (a and b)").collect()] == []
    same = spark.createDataFrame([(c,) for c in ("a b", " a\tb", "a b\xa0c", "Stück für", "")], "c string")
    assert same.where(T.letters_of(F.col("c")) != T.letters(F.col("c"))).count() == 0


def test_what_terms_come_from_is_gone_through_once(spark):
    """A name with many renderings is one range, and the rows that terms are made from are read once."""
    seen = spark.sparkContext.accumulator(0)

    def made(parts):
        for p in parts:
            seen.add(len(p))
            yield p.assign(source="name" + (p["id"] % 2).astype(str), rendering="r" + p["id"].astype(str))[["source", "rendering"]]

    terms = spark.range(4_000).mapInPandas(made, "source string, rendering string")
    texts = spark.createDataFrame([(1, "no such"), (2, "has name1 and name0"), (3, "name1name1"), (4, None)], "id int, text string")
    got = {r["id"]: [tuple(t) for t in r["terms"]] for r in profile.applicable(texts, ["id"], terms, by="source").collect()}
    of = lambda k: sorted((f"name{k}", f"r{i}") for i in range(k, 4_000, 2))
    assert got == {1: [], 2: of(0) + of(1), 3: of(1), 4: []}
    assert seen.value == 4_000


def test_parts_of_a_batch():
    import pyarrow as pa

    from quire.sources import shared

    batch = pa.RecordBatch.from_pydict({"n": list(range(600))})
    got = list(shared.parts([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert [b.num_rows for b in got] == [256, 256, 88, 3] and [x for b in got[:3] for x in b.column("n").to_pylist()] == list(range(600))
