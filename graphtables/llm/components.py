"""Connected components of links that may be many: alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtables.llm.common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("v", "u"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of every node to the least of them: the larger ones (large star) or the others (small star)."""
    sides = _both_ways(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    tied = sides.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(tmp: Scratch, edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) as (node, comp): each node of an edge with the least node that it reaches.

    Rounds are logarithmic in the number of nodes, each one is written out in place of
    the one before, and only a count and a sum of hashes come to the driver.
    """
    old = tmp.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(old)
    while mark[0]:
        new = tmp.table(_stars(_stars(old, True), False), "edges")
        now = _mark(new)
        tmp.free(old)
        old = new
        if now == mark:
            break
        mark = now
    return old.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(old.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
