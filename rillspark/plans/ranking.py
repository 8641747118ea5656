"""Positions along an axis without a window over everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys below 2^BITS share a block, 2^WIDE blocks a wide one: however sparse the keys, no window takes more than 2^WIDE rows.
BITS, WIDE = 16, 24

BEFORE = (Window.unboundedPreceding, -1)


def positions(keys: DataFrame, key: str, name: str, bits: int = BITS, first: Sequence[str] = ()) -> DataFrame:
    """``keys`` with ``name``, their 0-based place by ``first``, few different values, then by ``key``, distinct whole numbers.

    Keys are ranked in blocks of neighbours; where a block starts is told by the blocks' row counts, which are summed in wide
    blocks and over these in the same way.
    """
    first = list(first)
    blocks = keys.withColumn("_block", F.shiftright(key, bits))
    starts = _starts(blocks.groupBy(*first, "_block").agg(F.count(F.lit(1)).alias("_n")), first, 64 - bits)
    within = Window.partitionBy(*first, "_block").orderBy(key)
    placed = blocks.withColumn("_at", F.row_number().over(within) - 1).join(starts, [*first, "_block"])
    return placed.withColumn(name, F.col("_start") + F.col("_at")).drop("_block", "_at", "_start")


def _starts(counts: DataFrame, first: list[str], bits: int) -> DataFrame:
    """``(*first, _block, _start)`` of blocks with numbers of so many bits, from ``(*first, _block, _n)``."""
    before = lambda window: F.coalesce(F.sum("_n").over(window.rowsBetween(*BEFORE)), F.lit(0))
    if bits <= WIDE:
        return counts.select(*first, "_block", before(Window.partitionBy(F.lit(0)).orderBy(*first, "_block")).alias("_start"))
    wide = counts.withColumn("_wide", F.shiftright("_block", WIDE))
    sums = wide.groupBy(*first, "_wide").agg(F.sum("_n").alias("_n"))
    above = _starts(sums.withColumnRenamed("_wide", "_block"), first, bits - WIDE).withColumnsRenamed({"_block": "_wide", "_start": "_above"})
    inside = wide.withColumn("_inside", before(Window.partitionBy(*first, "_wide").orderBy("_block")))
    return inside.join(above, [*first, "_wide"]).select(*first, "_block", (F.col("_above") + F.col("_inside")).alias("_start"))
