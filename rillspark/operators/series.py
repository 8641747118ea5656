"""Lookups by feature and time, slices, series, and what a chart of a series shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.constants import FILL, LABELS, UNITS, VARIABLES
from rillspark.functions import values as V
from rillspark.model import Run


def at_step(run: Run, t_idx: int) -> DataFrame:
    """The cells of one step.  Its time is looked up first, so that the filter is on a literal and reaches below the last writes."""
    found = run.times.filter(F.col("t_idx") == t_idx).select("time").first()
    return run.at_time(found.time) if found else run.cells.filter(F.lit(False))


def point(run: Run, variable: str, feature_id: int, t_idx: int) -> DataFrame:
    """One row ``(value)``, null where the cell is missing."""
    hit = at_step(run, t_idx).filter(F.col("feature_id") == feature_id)
    return hit.agg(F.max(F.col(variable).cast("double")).alias("value"))


def series(run: Run, variable: str, feature_id: int) -> DataFrame:
    """``(t_idx, time, value)`` of one feature at every step, null where missing."""
    own = run.cells.filter(F.col("feature_id") == feature_id).select("time", F.col(variable).cast("double").alias("value"))
    return run.times.join(own, "time", "left").select("t_idx", "time", "value")


def time_slice(run: Run, variable: str, t_idx: int) -> DataFrame:
    """``(feature_id, value)`` of all features at a step, null where missing."""
    now = at_step(run, t_idx).select("feature_id", F.col(variable).cast("double").alias("value"))
    return run.features.select("feature_id").join(now, "feature_id", "left")


def paint(run: Run, variable: str, t_idx: int, visible: DataFrame) -> DataFrame:
    """The slice for the visible features that the run has."""
    return visible.select("feature_id").distinct().join(time_slice(run, variable, t_idx), "feature_id")


def unpainted(painted: DataFrame, slice_: DataFrame) -> DataFrame:
    """The slice without the features that are painted already."""
    return slice_.join(painted.select("feature_id"), "feature_id", "left_anti")


def record(run: Run, t_idx: int, wanted: DataFrame) -> DataFrame:
    """``(feature_id, label, flow, velocity, depth)`` of wanted features, known or not; null reads N/A."""
    now = at_step(run, t_idx).select("feature_id", *[F.col(v).cast("double").alias(v) for v in VARIABLES])
    return wanted.select("feature_id").join(now, "feature_id", "left").select("feature_id", V.feature_label(F.col("feature_id")).alias("label"), *VARIABLES)


def info(run: Run, variable: str, t_idx: int, wanted: DataFrame) -> DataFrame:
    """``(feature_id, value, key, property)``: a row for each property but ``id`` of the wanted ``(feature_id, properties)``."""
    now = time_slice(run, variable, t_idx)
    shown = F.map_filter("properties", lambda k, _: k != "id")
    return wanted.join(now, "feature_id", "left").select("feature_id", "value", F.explode(shown).alias("key", "property"))


def record_texts(run: Run, t_idx: int, wanted: DataFrame) -> DataFrame:
    """``record`` as it is shown: values of three digits with their units, ``N/A`` without one."""
    shown = [formatted(F.col(v), 3, UNITS[v], "N/A").alias(v) for v in VARIABLES]
    return record(run, t_idx, wanted).select("feature_id", "label", *shown)


def info_texts(run: Run, variable: str, t_idx: int, wanted: DataFrame) -> DataFrame:
    """``info`` as it is shown, a row for each line: the label, the value of four digits or ``--``, then the properties by name."""
    now = time_slice(run, variable, t_idx)
    properties = F.map_entries(F.map_filter("properties", lambda k, _: k != "id"))
    lines = F.concat(
        F.array(
            F.struct(F.lit("id").alias("key"), V.feature_label(F.col("feature_id")).alias("text")),
            F.struct(F.lit(LABELS[variable]).alias("key"), F.col("shown").alias("text")),
        ),
        F.transform(F.coalesce(F.sort_array(properties), F.array()), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text"))),
    )
    shown = wanted.join(now, "feature_id", "left").withColumn("shown", formatted(F.col("value"), 4, UNITS[variable], "--"))
    return shown.select("feature_id", F.posexplode(lines).alias("line", "l")).select("feature_id", "line", "l.key", "l.text")


def formatted(value: Column, digits: int, units: str, missing: str) -> Column:
    """A value as text, with its units or the mark of a missing one."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.concat_ws(" ", V.to_fixed(digits)(value), F.lit(units)))


def grid(run: Run, *variables: str) -> DataFrame:
    """``(feature_id, row_idx, t_idx)`` and the variables of every feature at every step: the dense grid, null where missing."""
    steps = F.sequence(F.lit(0), F.lit(run.n_times - 1)) if run.n_times else F.array()
    kind = run.times.schema["t_idx"].dataType.simpleString()
    # A feature's places are made from its own row, without a join.
    places = run.features.select("feature_id", "row_idx", F.explode(steps.cast(f"array<{kind}>")).alias("t_idx"))
    cells = run.cells.join(run.steps(), "time").select("feature_id", "t_idx", *[F.col(v).cast("double").alias(v) for v in variables])
    return places.join(cells, ["feature_id", "t_idx"], "left")


def whole_series(run: Run, variable: str) -> DataFrame:
    """``(feature_id, t_idx, value)`` of the dense grid, null where missing."""
    return grid(run, variable).select("feature_id", "t_idx", F.col(variable).alias("value"))


def segments(run: Run, variable: str) -> DataFrame:
    """``(feature_id, segment, first_t, last_t, points)``: the stretches of each series between missing values."""
    at = Window.partitionBy("feature_id").orderBy("t_idx")
    cells = run.cells.filter(F.col(variable).isNotNull()).join(run.steps(), "time").select("feature_id", "t_idx")
    # Steps that follow each other differ from their rank by the same number: missing cells needn't be made.
    islands = cells.withColumn("island", F.col("t_idx") - F.row_number().over(at))
    found = islands.groupBy("feature_id", "island").agg(F.min("t_idx").alias("first_t"), F.max("t_idx").alias("last_t"), F.count(F.lit(1)).alias("points"))
    return found.select("feature_id", (F.row_number().over(Window.partitionBy("feature_id").orderBy("first_t")) - 1).alias("segment"), "first_t", "last_t", "points")


def chart(run: Run, variable: str) -> DataFrame:
    """``(feature_id, t_idx, x, y)`` of the valid points, from 0 to 1; x is null in a run of one step."""
    own = Window.partitionBy("feature_id")
    n = run.n_times
    cells = run.cells.filter(F.col(variable).isNotNull()).join(run.steps(), "time").select("feature_id", "t_idx", F.col(variable).cast("double").alias("v"))
    low, high = F.min("v").over(own), F.max("v").over(own)
    reach = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return cells.select("feature_id", "t_idx", F.try_divide(F.col("t_idx"), F.lit(n - 1)).alias("x"), ((F.col("v") - low) / reach).alias("y"))


def playback_steps(run: Run) -> DataFrame:
    """``(t_idx, next_t, previous_t)`` of every step, round the ends."""
    n = run.n_times
    t = F.col("t_idx")
    return run.times.select("t_idx", V.step(t, 1, n).alias("next_t"), V.step(t, -1, n).alias("previous_t"))


def dense_matrix(run: Run) -> DataFrame:
    """``(cell_idx, row_idx, t_idx, flow, velocity, depth)`` of the whole grid, the fill value where missing."""
    filled = [F.coalesce(F.col(v), F.lit(FILL)).alias(v) for v in VARIABLES]
    return grid(run, *VARIABLES).select((F.col("row_idx") * run.n_times + F.col("t_idx")).alias("cell_idx"), "row_idx", "t_idx", *filled)
