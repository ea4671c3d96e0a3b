"""Streams against their batch twins: events and entries in any order, over many micro-batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.plans import queries
from quire.streaming import ledger

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")
ENTRIES = "scope long, at timestamp, seq long, purpose string, authority string, outcome string, bytes_sent long, bytes_received long"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def streamed(spark, tmp_path, batches, schema, made, name):
    """The last row of each key after all ``batches``, a micro-batch each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(tmp_path / "in", (i, i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = made(stream).withColumn("__n", F.lit(0)).drop("__n").writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["batch"]):
        last[r[name]] = {k: v for k, v in r.asDict().items() if k != "batch"}
    return last


def test_late_events_overwrite_nothing(spark, tmp_path):
    n = F.col("event_id")
    events = spark.read.parquet(f"{SF}/events.parquet")
    kind = F.when(n % 8 == 0, "started").when(n % 8 == 1, "pageStarted").when(n % 8 == 2, "pageReconciled").when((n % 8 == 7) & (n % 5 == 0), "finished").otherwise("blockTranslated")
    rows = [tuple(r) for r in events.select((F.col("user_id") % 40).alias("job"), n.alias("seq"), kind.alias("event"), (n % 6).alias("value"), (n % 9 + 3).alias("of")).limit(4000).collect()]
    schema = "job long, seq long, event string, value long, of long"
    want = {r["job"]: r.asDict() for r in ledger.progress(spark.createDataFrame(rows, schema)).collect()}
    random.Random(2).shuffle(rows)
    assert streamed(spark, tmp_path, [rows[i::6] for i in range(6)], schema, ledger.progress_stream, "job") == want


@pytest.mark.parametrize(("late", "spread"), [("10000 days", None), ("2 days", 86_400)])
def test_ledger_in_any_order(spark, tmp_path, late, spread):
    """Entries in any order, and entries up to a day late with two days to wait: totals, clearings and the latest agree."""
    rows = [tuple(r) for r in queries.clearing_entries(spark, SF).withColumn("scope", F.col("scope") % 5).select(*[c.split()[0] for c in ENTRIES.split(", ")]).collect()]
    r = random.Random(3)
    want = {x["scope"]: x.asDict() for x in ledger.present(spark.createDataFrame(rows, ENTRIES), ["scope"], 50).collect()}
    if spread:
        rows.sort(key=lambda e: e[1].timestamp() + r.uniform(0, spread))
        each = -(-len(rows) // 8)
        batches = [rows[i : i + each] for i in range(0, len(rows), each)]
    else:
        r.shuffle(rows)
        batches = [rows[i::5] for i in range(5)]
    got = streamed(spark, tmp_path, batches, ENTRIES, lambda s: ledger.present_stream(s, "scope", late, 50), "scope")
    assert {k: got[k] for k in want} == want
    assert any(v["requests"] > 50 for v in want.values())
