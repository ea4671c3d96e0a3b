"""Which models a machine can hold, and which of the installed ones are in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep

#: Bytes that a model takes while it works, the share of memory that counts, and what a download leaves free.
GROWTH, OWN, SHARE, SPARE = 1.4, 3.0e9, 0.75, 1.0e9


def working_set(weights: Column) -> Column:
    """Bytes that a model takes while it works: 1.4 times its weights and 3 GB."""
    return weights * GROWTH + OWN


def obstacle(silicon: Column, memory: Column, disk: Column, weights: Column, beside: Column | None = None) -> Column:
    """The first thing in the way of a model: silicon, another model's memory (``beside``: its weights; null for none),
    memory (three quarters of it count), disk (a gigabyte is left over); null if nothing is."""
    usable = memory * SHARE
    out = F.when(~silicon, "silicon")
    if beside is not None:
        out = out.when(working_set(weights) + working_set(beside) > usable, "both")
    return out.when(working_set(weights) > usable, "memory").when(weights + SPARE > disk, "disk")


def _limit(memory: Column, disk: Column, holding: Column) -> Column:
    """The largest number that fits as a model's weights, exactly as :func:`working_set` rounds; null for none.

    What fits grows with memory and disk, so the bits of the number are settled from the highest on, down to those of
    weights of one byte.
    """
    fits = lambda w: (working_set(w) + holding <= memory * SHARE) & (w + SPARE <= disk)
    top = F.least(F.floor(F.log2(memory)), F.lit(1000)).cast("int")
    bits = F.sequence(top, F.lit(-52), F.lit(-1))
    found = F.aggregate(bits, F.lit(0.0), lambda acc, k: F.when(fits(acc + F.pow(F.lit(2.0), k)), acc + F.pow(F.lit(2.0), k)).otherwise(acc))
    return F.when((memory >= 1) & fits(F.lit(1.0)), found)


def admitted(models: DataFrame, machines: DataFrame, disk: bool = True) -> DataFrame:
    """machine_id, model_id: the largest model (model_id, weights) that each machine can hold; of equals the smallest id.

    Machines are (machine_id, silicon, memory, disk) and, where another model is held as well, holding: its working
    set. Without ``disk`` only memory counts. Models of equal weights are one, and so are machines of equal parts. Their limits
    and the weights are dealt by range and each limit takes the last weight up to it, of its own range or of those
    before; so the work grows with the tables' lengths, however many models a machine could hold.
    """
    holding = F.coalesce("holding", F.lit(0.0)) if "holding" in machines.columns else F.lit(0.0)
    m = machines.where("silicon").select("machine_id", F.col("memory").cast("double").alias("memory"), (F.col("disk").cast("double") if disk else F.lit(float("inf"))).alias("disk"), holding.cast("double").alias("holding"))
    kinds = m.select("memory", "disk", "holding").distinct().withColumn("at", _limit(F.col("memory"), F.col("disk"), F.col("holding"))).where("at is not null")
    weights = models.where("weights >= 1").groupBy(F.col("weights").cast("double").alias("at")).agg(F.min("model_id").alias("model_id"))
    weights = weights.select("at", F.struct((-F.col("at")).alias("down"), "model_id").alias("model"))
    asked = kinds.select("at", F.lit(None).cast(weights.schema["model"].dataType).alias("model")).distinct()
    line = keep(weights.unionByName(asked).repartitionByRange("at").withColumn("part", F.spark_partition_id()), "weights")
    parts = line.groupBy("part").agg(F.min("model").alias("last"))
    before = parts.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row a range
    upto = Window.partitionBy("part").orderBy("at", F.col("model").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = line.withColumn("own", F.last("model", ignorenulls=True).over(upto)).where("model is null").join(F.broadcast(before), "part")
    fits = kinds.join(taken.select("at", F.coalesce("own", "before").alias("model")), "at").select("memory", "disk", "holding", "model")
    best = m.join(fits, ["memory", "disk", "holding"]).groupBy("machine_id").agg(F.min("model").alias("model"))
    found = best.select("machine_id", F.col("model.model_id").alias("model_id"))
    return machines.select("machine_id").join(found, "machine_id", "left")


def recommended(models: DataFrame, machines: DataFrame, installed: DataFrame) -> DataFrame:
    """machine_id, model_id: the largest model that fits a machine's memory among those on its disk (machine_id,
    model_id), else the largest of all that fit."""
    here = installed.join(models, "model_id").join(machines, "machine_id").where(obstacle(F.col("silicon"), F.col("memory"), F.lit(float("inf")), F.col("weights")).isNull())
    best = here.groupBy("machine_id").agg(F.min(F.struct((-F.col("weights")).alias("down"), "model_id")).alias("b")).select("machine_id", F.col("b.model_id").alias("own"))
    return admitted(models, machines, disk=False).join(best, "machine_id", "left").select("machine_id", F.coalesce("own", "model_id").alias("model_id"))


def specified(installed: DataFrame, models: DataFrame) -> DataFrame:
    """``installed`` (model_id, bytes) with its entry of the catalogue (name), and whether it has none: an orphan."""
    return installed.join(models.select("model_id", "name"), "model_id", "left").withColumn("orphan", F.col("name").isNull())


def unused(installed: DataFrame, in_use: DataFrame) -> DataFrame:
    """Installed models that no setting uses; null settings use none."""
    return installed.join(in_use.where("model_id is not null").select("model_id").distinct(), "model_id", "left_anti")


def storage(installed: DataFrame) -> DataFrame:
    """n_models, bytes of all installed models; no rows are 0 bytes."""
    return installed.agg(F.count("*").alias("n_models"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
