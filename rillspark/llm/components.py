"""Connected components of a table of edges, by alternating star operations on DataFrames.

After Kiveris et al., "Connected components in MapReduce and beyond": every node links its larger neighbours to the smallest
node it knows, then its smaller ones, until only stars are left.  Each step is a minimum by node, combined before the
shuffle, and a join, so a hub's edges are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _link(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """``(u, v)`` with ``m``, the smallest node that u knows."""
    return edges.join(smallest.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).drop("_u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` ``(u, v)`` that isn't the smallest of its component.

    Nodes are of any type with an order.  Loops and repeated edges don't matter; edges with a null end are left out; without
    edges the result is empty.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), label)
        large = cut(_link(both.filter("v > u"), smallest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = _link(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        for table in (now, smallest, large, least):
            drop(table)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
