"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(e: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def _least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n), n being the rows of u. Nodes with a thousandth of all rows, a thousand at most, are broadcast, so hubs stay spread."""
    hot_from = max(100, total // 1000)
    hubs = F.broadcast(least.where(F.col("n") >= hot_from).select("u", "m"))
    spread = rows.join(hubs, "u").select("u", "v", "m")
    return rows.join(hubs, "u", "left_anti").join(least.where(F.col("n") < hot_from).select("u", "m"), "u").select("u", "v", "m").unionByName(spread)


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(u, root) for every node of edges (u, v) but the roots; root is the smallest node that u reaches.

    Each step is a map-side combined minimum and a join on the node, in which the few nodes with many edges are broadcast and not shuffled; it ends when all
    edges are stars. The edges of each round are a table in the shared folder that replaces the last one, so lineage stays short and nothing is
    collected. The table returned is written too (discard() it).
    """
    e = common.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _stars(e):
        total = 2 * e.count()  # neither step has more rows
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = common.keep(_least(both, least, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _least(large, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, common.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        common.discard(last, large)
    out = e.withColumnRenamed("v", "root")
    out._folio_path = e._folio_path
    return out
