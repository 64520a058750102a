"""Connected components of a link table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of those neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u long, v long); component is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need O(log^2 n) rounds even for long chains.
    A step is a partially aggregated minimum and a join, so that a hub's links never meet in one task, and its result is
    written to the shared folder. Empty input gives an empty result; self links and repeated links do no harm. A node whose
    only link is to itself is not returned.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialise(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    seen = mark(now)
    while seen[0]:
        now = materialise(_small_star(_large_star(now)), "links")
        if (new := mark(now)) == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
