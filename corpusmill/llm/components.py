"""Connected components by alternating stars (Kiveris et al., 2014), on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.llm.store import dropped, written


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, and their number and digest, taken while they were written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
    return table, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of ``links`` (a, b: longs) with the smallest node of its component.

    Each step groups by a node and joins its smallest neighbour back, so no node's links meet in one task
    unless Spark can split them.
    """
    edges, now = _kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while now != before and now[0]:
        before, last = now, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
