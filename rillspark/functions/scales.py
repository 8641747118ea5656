"""Colour scales: a transform of the value, the ends it maps a variable's bounds to, and stops in the transformed space."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillspark.constants import PALETTE_RGB, STEP, WIDTHS

TRANSFORMS = ("linear", "log", "sqrt", "cbrt", "symlog")
CLASSED = ("quantile-classes", "jenks")


@dataclass(frozen=True)
class Scale:
    """What a scale makes of a variable with bounds [low, high]."""

    name: str
    low: float
    high: float

    @property
    def _log_low(self) -> float:
        return max(self.low, 1e-6)

    @property
    def _linear_until(self) -> float:
        return max(self.high / 100, 1e-6)

    def transform(self, v: Column) -> Column:
        if self.name == "log":
            return F.log10(F.greatest(v, F.lit(self._log_low)))
        if self.name in ("sqrt", "cbrt"):
            reach = self.high - self.low if self.high > self.low else 1.0
            return F.pow((F.greatest(v, F.lit(self.low)) - self.low) / reach, F.lit(1 / 2 if self.name == "sqrt" else 1 / 3))
        if self.name == "symlog":
            until = F.lit(self._linear_until)
            return F.when(v <= until, v / until).otherwise(1 + F.log10(F.greatest(v, F.lit(1e-9)) / until))
        return v

    def _symlog(self, v: float) -> float:
        return v / self._linear_until if v <= self._linear_until else 1 + math.log10(max(v, 1e-9) / self._linear_until)

    def ends(self) -> tuple[float, float]:
        """The transformed bounds, the upper one moved up if they coincide."""
        if self.name == "log":
            a, b = math.log10(self._log_low), math.log10(max(self.high, 10 * self._log_low))
        elif self.name in ("sqrt", "cbrt"):
            a, b = 0.0, 1.0
        elif self.name == "symlog":
            a, b = self._symlog(self.low), self._symlog(self.high)
        else:
            a, b = self.low, self.high
        return a, b if b > a else a + 1

    def stops(self) -> list[float]:
        a, b = self.ends()
        last = len(PALETTE_RGB) - 1
        return [a + (b - a) * i / last for i in range(last + 1)]


def strictly_increasing(values: list[float]) -> list[float]:
    """Each value above the one before, by the smallest step where it isn't."""
    out: list[float] = []
    for v in values:
        out.append(v if not out or v > out[-1] else out[-1] + STEP)
    return out


def ramp_position(v: Column, stops: list[float]) -> Column:
    """0 at the first stop, 1 at the second and so on, linear between them, the ends beyond."""
    position = F.when(v <= stops[0], F.lit(0.0))
    for i, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
        position = position.when(v <= b, i + (v - a) / (b - a))
    return position.otherwise(F.lit(float(len(stops) - 1)))


def ramp_channels(position: Column) -> dict[str, Column]:
    """Red, green and blue, 0 to 255 unrounded, at a position on the palette."""
    at = F.least(F.floor(position), F.lit(len(PALETTE_RGB) - 2)).cast("int")
    out = {}
    for k, name in enumerate(("red", "green", "blue")):
        ramp = F.array(*[F.lit(float(c[k])) for c in PALETTE_RGB])
        here, there = F.get(ramp, at), F.get(ramp, at + 1)
        out[name] = here + (there - here) * (position - at)
    return out


def class_index(v: Column, breaks: list[float]) -> Column:
    """The number of breaks at or below the value."""
    index = F.lit(0)
    for b in breaks:
        index = index + (v >= b).cast("int")
    return index


def hex_color(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02x%02x%02x", *[F.round(c).cast("int") for c in (red, green, blue)])


def line_width(v: Column, low: float, high: float) -> Column:
    """0 without data, else between the widths of the least and the largest value."""
    top = high if high > low else low + 1
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (top - low)))
    return F.when(v.isNull(), F.lit(0.0)).otherwise(WIDTHS[0] + (WIDTHS[1] - WIDTHS[0]) * share)


def order_width(order: Column, base: float = 1.6, low: tuple[float, float] = (1.0, 1.0), high: tuple[float, float] = (8.0, 6.0)) -> Column:
    """A default line's width by stream order, exponential between two (order, width) points."""
    x = F.least(F.greatest(order, F.lit(low[0])), F.lit(high[0]))
    share = (F.pow(F.lit(base), x - low[0]) - 1) / (base ** (high[0] - low[0]) - 1)
    return low[1] + (high[1] - low[1]) * share
