"""Values as colours, classes and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.constants import NO_DATA_COLOR
from rillspark.functions import scales as S
from rillspark.model import Run
from rillspark.operators import aggregates, distribution


def stops(run: Run, variable: str, scale: str) -> list[float]:
    """Where the ramp's colours stand: on the transformed axis, or at the sample's quantiles."""
    if scale == "quantile":
        return distribution.quantile_stops(run, variable)
    return S.Scale(scale, *aggregates.bounds_values(run, variable)).stops()


def breaks(run: Run, variable: str, scale: str) -> list[float]:
    return distribution.jenks_breaks(run, variable) if scale == "jenks" else distribution.quantile_class_breaks(run, variable)


def position(run: Run, variable: str, scale: str, value: Column) -> Column:
    """The place of a value on the palette, 0 to 5: whole numbers for the classed scales."""
    if scale in S.CLASSED:
        return S.class_index(value, breaks(run, variable, scale)).cast("double")
    if scale == "quantile":
        return S.ramp_position(value, stops(run, variable, scale))
    transform = S.Scale(scale, *aggregates.bounds_values(run, variable))
    return S.ramp_position(transform.transform(value), transform.stops())


def colorize(run: Run, variable: str, scale: str, values: DataFrame) -> DataFrame:
    """``values`` ``(feature_id, value)`` with ``position``, ``red``, ``green``, ``blue`` and ``color``; null without data."""
    placed = values.withColumn("position", F.when(F.col("value").isNotNull(), position(run, variable, scale, F.col("value"))))
    channels = S.ramp_channels(F.col("position"))
    with_channels = placed.withColumns(channels)
    color = F.when(F.col("position").isNull(), F.lit(NO_DATA_COLOR)).otherwise(S.hex_color(F.col("red"), F.col("green"), F.col("blue")))
    return with_channels.withColumn("color", color)


def classify(run: Run, variable: str, scale: str, values: DataFrame) -> DataFrame:
    """``values`` with ``class_index`` of a classed scale, null without data."""
    return values.withColumn("class_index", F.when(F.col("value").isNotNull(), S.class_index(F.col("value"), breaks(run, variable, scale))))


def widths(run: Run, variable: str, values: DataFrame) -> DataFrame:
    return values.withColumn("width", S.line_width(F.col("value"), *aggregates.bounds_values(run, variable)))


def frame(run: Run, variable: str, t_idx: int, scale: str, visible: DataFrame | None = None) -> DataFrame:
    """What a map shows of a variable at a step: colour and width of every visible feature."""
    from rillspark.operators import series

    values = series.time_slice(run, variable, t_idx) if visible is None else series.paint(run, variable, t_idx, visible)
    return widths(run, variable, colorize(run, variable, scale, values))
