"""Extents and regions of line geometries ``(feature_id, coordinates array<array<struct<x, y>>>)``; a single line is an array of one."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions import values as V
from rillspark.model import BROADCAST_ROWS

#: Tiles along one side of a stretch's box, above which the index cuts the stretch into parts.
SIDE_TILES = 8
#: Tiles along the lines that one task finds at a zoom.
TASK_TILES = 1 << 18


def _vertices(lines: DataFrame) -> DataFrame:
    return lines.select("feature_id", F.explode(F.flatten("coordinates")).alias("p")).select("feature_id", "p.x", "p.y")


def _extent() -> list:
    return [F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")]


def loaded_extent(lines: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row: the extent of the lines whose feature is loaded, nulls if there is none."""
    return _vertices(lines.join(loaded.select("feature_id"), "feature_id", "left_semi")).agg(*_extent())


def feature_boxes(lines: DataFrame) -> DataFrame:
    """``(feature_id, min_x, min_y, max_x, max_y)``; vertices are folded within the row, nothing is shuffled."""
    flat = F.flatten("coordinates")
    part = lambda f, k: f(F.transform(flat, lambda p: p[k]))
    boxes = lines.select("feature_id", part(F.array_min, "x").alias("min_x"), part(F.array_min, "y").alias("min_y"), part(F.array_max, "x").alias("max_x"), part(F.array_max, "y").alias("max_y"))
    return boxes


def in_box(boxes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The features whose box meets the region; the conditions are on columns and reach the scan of stored boxes."""
    return boxes.filter((F.col("min_x") <= east) & (F.col("max_x") >= west) & (F.col("min_y") <= north) & (F.col("max_y") >= south))


def segments(lines: DataFrame) -> DataFrame:
    """``(feature_id, x0, y0, x1, y1)`` of every stretch between two vertices; a line of one vertex is a stretch of no length."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("line") - 1)), lambda i: F.struct(F.get("line", i - 1).alias("a"), F.coalesce(F.get("line", i), F.get("line", i - 1)).alias("b")))
    one = lines.select("feature_id", F.explode("coordinates").alias("line")).filter(F.size("line") > 0)
    return one.select("feature_id", F.explode(steps).alias("s")).select("feature_id", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def meets_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether the stretch ``x0, y0, x1, y1`` has a point in the box: the parts of it between each pair of sides have one in common."""

    def part(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = F.nullif(b - a, F.lit(0.0))
        one, other = (low - a) / d, (high - a) / d
        inside = (a >= low) & (a <= high)  # of a stretch along the sides all or nothing is between them
        return F.coalesce(F.least(one, other), F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))), F.coalesce(F.greatest(one, other), F.lit(1.0))

    (x_in, x_out), (y_in, y_out) = part(F.col("x0"), F.col("x1"), west, east), part(F.col("y0"), F.col("y1"), south, north)
    return F.greatest(F.lit(0.0), x_in, y_in) <= F.least(F.lit(1.0), x_out, y_out)


def tile_index(lines: DataFrame, zoom: int) -> DataFrame:
    """``(z, x, y, feature_id, x0, y0, x1, y1)``: for every stretch of the lines the tiles of a zoom that its box meets, edges included.

    A long stretch goes in as parts, so that a diagonal lists the tiles along it and not the square around it: the rows grow
    with a stretch's length.  A tile where two parts of a stretch meet is listed for both; no row waits for another.
    """
    z, n = F.lit(zoom), float(1 << zoom)
    wide = F.greatest(F.abs(F.col("x1") - F.col("x0")) / 360 * n, F.abs(F.col("y1") - F.col("y0")) / 180 * n)
    parts = segments(lines).withColumn("parts", F.greatest(F.lit(1), F.ceil(wide / SIDE_TILES)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    along = lambda c, i: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * i / F.col("parts")
    ends = [V.tile_place(z, along("x", i), along("y", i)) for i in (F.col("i"), F.col("i") + 1)]
    low = lambda c: V.within_square(F.ceil(F.least(ends[0][c], ends[1][c])) - 1, z)
    high = lambda c: V.within_square(F.floor(F.greatest(ends[0][c], ends[1][c])), z)
    stretch = ["feature_id", "x0", "y0", "x1", "y1"]
    found = parts.select(*stretch, F.sequence(low("x"), high("x")).alias("xs"), F.sequence(low("y"), high("y")).alias("ys"))
    return found.select(*stretch, F.explode("xs").alias("x"), "ys").select(F.lit(zoom).alias("z"), "x", F.explode("ys").alias("y"), *stretch)


def _dealt(lines: DataFrame, zoom: int) -> DataFrame:
    """The lines dealt by feature to as many tasks as let each find ``TASK_TILES`` tiles of a zoom, which are estimated in one pass."""
    n = float(1 << zoom)
    along = 1 + F.abs(F.col("x1") - F.col("x0")) / 360 * n + F.abs(F.col("y1") - F.col("y0")) / 180 * n
    tiles = segments(lines).agg(F.sum(F.least(along, F.lit(2 * n + 1)))).first()[0] or 0  # no stretch of the map is longer
    return lines.select("feature_id", "coordinates").repartition(max(1, math.ceil(tiles / TASK_TILES)), "feature_id")


def tile_features(lines: DataFrame, tiles: DataFrame) -> DataFrame:
    """``(z, x, y, feature_id)``: the features with a point in each of the tiles ``(z, x, y)``, by an equi-join on the index.

    The index finds the tiles that a stretch may meet; whether it does is told by clipping it to the tile's box.  Zooms are few and
    are looked up first.  The tiles of a zoom are broadcast up to ``BROADCAST_ROWS``; then only the lines are shuffled, and what is
    found of a feature is already with one task, which has as many features as ``_dealt`` gives it.
    """
    asked = tiles.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).filter("z IS NOT NULL").distinct()
    counts = {r.z: r.n for r in asked.groupBy("z").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one for each zoom level
    if not counts:
        return asked.select("*", F.lit(None).cast("long").alias("feature_id")).limit(0)
    dealt = _dealt(lines, max(counts))
    box = V.tile_bbox(F.col("z"), F.col("x"), F.col("y"), F.lit(0))
    exact = meets_box(box["west"], box["south"], box["east"], box["north"])

    def found(zoom: int) -> DataFrame:
        these = asked.filter(F.col("z") == zoom)
        these = F.broadcast(these) if counts[zoom] <= BROADCAST_ROWS else these
        return these.join(tile_index(dealt, zoom), ["z", "x", "y"]).filter(exact).select("z", "x", "y", "feature_id")

    return reduce(DataFrame.unionByName, [found(z) for z in sorted(counts)]).distinct()
