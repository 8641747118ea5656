"""Bounds, totals, per-feature extremes, and what is known of a run as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.constants import LABELS, SCALE_NOTES, UNITS, VARIABLES
from rillspark.functions import values as V
from rillspark.model import Run


def bounds_of(variable: str) -> list[Column]:
    """Least and largest valid value in double precision, 0 and 1 if there is none."""
    v = F.col(variable).cast("double")
    return [F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(1.0)).alias("max")]


def bounds(run: Run, variable: str) -> DataFrame:
    return run.cells.agg(*bounds_of(variable))


def all_bounds(run: Run) -> DataFrame:
    """``(variable, min, max)`` of the three variables from one pass over the cells."""
    low = lambda v: bounds_of(v)[0].alias(f"{v}_min")
    high = lambda v: bounds_of(v)[1].alias(f"{v}_max")
    wide = run.cells.agg(*[f(v) for v in VARIABLES for f in (low, high)])
    return wide.select(F.expr(f"stack({len(VARIABLES)}, {', '.join(f"'{v}', {v}_min, {v}_max" for v in VARIABLES)}) AS (variable, min, max)"))


def bounds_values(run: Run, variable: str) -> tuple[float, float]:
    row = bounds(run, variable).first()
    return row["min"], row["max"]


def totals_by_time(run: Run, variable: str) -> DataFrame:
    """``(t_idx, time, total)``: the sum over all features, 0 for a step without any valid value."""
    sums = run.cells.groupBy("time").agg(F.sum(F.col(variable).cast("double")).alias("total"))
    return run.times.join(sums, "time", "left").select("t_idx", "time", F.coalesce("total", F.lit(0.0)).alias("total"))


def overview(run: Run, variable: str) -> DataFrame:
    """The totals with ``x`` and ``y`` from 0 to 1; a single step stands in the middle, a flat line at 0."""
    totals = totals_by_time(run, variable)
    ends = totals.agg(F.min("total").alias("low"), F.max("total").alias("high"), F.max("t_idx").alias("last"))  # one row
    reach = F.when(F.col("high") - F.col("low") == 0, F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
    x = F.when(F.col("last") == 0, F.lit(0.5)).otherwise(F.col("t_idx") / F.nullif(F.col("last"), F.lit(0)))
    return totals.join(F.broadcast(ends)).select("t_idx", "time", "total", x.alias("x"), ((F.col("total") - F.col("low")) / reach).alias("y"))


def feature_extremes(run: Run, variable: str) -> DataFrame:
    """``(feature_id, min, max, range)`` of features with a valid value; the range is 1 where it would be 0."""
    v = F.col(variable).cast("double")
    found = run.cells.filter(F.col(variable).isNotNull()).groupBy("feature_id").agg(F.min(v).alias("min"), F.max(v).alias("max"))
    return found.withColumn("range", F.when(F.col("max") == F.col("min"), F.lit(1.0)).otherwise(F.col("max") - F.col("min")))


def dataset_info(run: Run) -> DataFrame:
    """One row: features, time steps, matched (the features again), the reference date or N/A, and ids that have a cell."""
    counts = run.features.agg(F.count(F.lit(1)).alias("features")).join(run.times.agg(F.count(F.lit(1)).alias("time_steps")))
    with_cells = run.cells.agg(F.count_distinct("feature_id").alias("features_with_cells"))
    return counts.join(with_cells).select("features", "time_steps", F.col("features").alias("matched"), V.ref_date(F.lit(run.ref_time).cast("string")).alias("ref_date"), "features_with_cells")


def legend(run: Run, variable: str, scale: str) -> DataFrame:
    """One row: the title, and the bounds whatever the scale."""
    note = "" if scale == "linear" else f" · {SCALE_NOTES[scale]}"
    return bounds(run, variable).select(F.lit(f"{LABELS[variable]} ({UNITS[variable]}){note}").alias("title"), "min", "max")
