"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to u's smallest neighbour."""
    both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(low, "u")
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def _stars(e: DataFrame) -> bool:
    """Whether the edges are stars: each u has one edge, and no u is a v."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("of")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("own").alias("own"), F.sum("of").alias("of")).where("own > 1 or own > 0 and of > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, root) for each node that has an edge to another node; root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars. Each round is
    written to the shared folder, so a lost executor repeats at most one round. Null nodes and loops are ignored;
    nodes without edges have no row. The number of rounds is logarithmic in the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null").where("u <> v").distinct()
    e = keep(e, name)
    while not _stars(e):
        big = _large_star(e).distinct()
        before, e = e, keep(_small_star(big).where("u <> v").distinct(), name)
        drop(before)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select("v", "v").distinct())
