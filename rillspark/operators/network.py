"""Upstream sets of a river network kept as nested sets: positions in pre-order, and the size of the tree above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of one bin of the interval join.  An interval spans no more bins than it has members, over BIN, and two.
BIN = 1024


def selected(divides: DataFrame, upstream_id: int) -> DataFrame:
    return divides.filter(F.col("upstream_id") == upstream_id)


def upstream(divides: DataFrame, upstream_id: int, num_upstreams: int | None) -> DataFrame:
    """The divides above one: a filter on literals, which reaches the scan.  An unknown number means none."""
    n = num_upstreams or 0
    return divides.filter((F.col("upstream_id") > upstream_id) & (F.col("upstream_id") <= upstream_id + n))


def upstream_pairs(chosen: DataFrame, divides: DataFrame, width: int = BIN) -> DataFrame:
    """``(upstream_id, member_id)`` for many divides at once: an equi-join on bins of positions, then the exact interval."""
    bin_of = lambda c: F.floor(c / width)
    n = F.coalesce(F.col("num_upstreams"), F.lit(0))
    spans = chosen.filter(n > 0).select("upstream_id", n.alias("n"), F.explode(F.sequence(bin_of(F.col("upstream_id") + 1), bin_of(F.col("upstream_id") + n))).alias("bin"))
    members = divides.select(F.col("upstream_id").alias("member_id"), bin_of(F.col("upstream_id")).alias("bin"))
    inside = (F.col("member_id") > F.col("upstream_id")) & (F.col("member_id") <= F.col("upstream_id") + F.col("n"))
    return spans.join(members, "bin").filter(inside).select("upstream_id", "member_id")
