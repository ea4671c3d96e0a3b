"""Queries and shards meet without a broadcast."""

from pyspark.sql import functions as F

from quire.llm import ann


def test_nearest_sends_no_queries_to_all(spark):
    """Queries meet shards by shuffle: joined by broadcast they were held whole, once a shard, by the driver."""
    v = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(k).cast("float") for k in range(8)]).alias("embedding"))
    got = ann.nearest(v.where("vec_id % 10 = 0"), v, 3, shard_rows=200, block_rows=50)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 900
    assert got.where("vec_id = query_id").count() == 0
