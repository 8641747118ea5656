"""Column functions of single values: validity, narrowing, times, text."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.constants import FILL, VALID_ABOVE


def valid(v: Column) -> Column:
    """The value, null if it is missing: at or below the threshold, NaN or null."""
    return F.when((v > VALID_ABOVE) & ~F.isnan(v), v)


def is_no_data(v: Column) -> Column:
    """The test by which maps and lines leave a value out; a null stands for the fill value."""
    return with_fill(v) <= VALID_ABOVE


def with_fill(v: Column) -> Column:
    return F.coalesce(v, F.lit(FILL))


def narrowed(v: Column) -> Column:
    """To single precision, as stored; aggregates are taken in double precision after it."""
    return v.cast("float")


def feature_id(v: Column) -> Column:
    """A number of 64 bits; what isn't one is null, and the row is rejected."""
    return v.try_cast("bigint")


def epoch_ms(v: Column, kind: T.DataType) -> Column:
    """Milliseconds since 1970 of a timestamp, of one without a zone or a date as UTC, or of a number that already is one."""
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(v)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        here = F.convert_timezone(F.lit("UTC"), F.current_timezone(), v.cast("timestamp_ntz"))
        return F.unix_millis(here.cast("timestamp"))
    return v.cast("bigint")


def time_label(time: Column, kind: str) -> Column:
    """``2026-07-20 06:00Z`` of epoch milliseconds (the minutes are dropped), ``T+2h`` of an offset in seconds."""
    if kind == "epoch_ms":
        return F.date_format(F.to_utc_timestamp(F.timestamp_millis(time), F.current_timezone()), "yyyy-MM-dd HH':00Z'")
    return F.concat(F.lit("T+"), F.floor(time / 3600).cast("string"), F.lit("h"))


def ref_date(ref_time: Column) -> Column:
    return F.coalesce(F.substring(ref_time, 1, 10), F.lit("N/A"))


def feature_label(feature: Column) -> Column:
    return F.concat(F.lit("wb-"), feature.cast("string"))


def seek_index(fraction: Column, n_times: int) -> Column:
    """The time step at a fraction of the axis; halves round up."""
    return F.greatest(F.lit(0), F.least(F.lit(n_times - 1), F.floor(fraction * (n_times - 1) + 0.5))).cast("int")


def step(t: Column, by: int, n_times: int) -> Column:
    """The step after (by 1) or before (by -1), round the ends."""
    return F.pmod(t + by, F.lit(n_times)).cast("int")


def playback_ms(speed: float) -> float:
    return 2500 / speed


def to_fixed(digits: int):
    """The column function that writes a double with so many digits, by its exact binary value, halves away from zero."""
    quantum = Decimal(1).scaleb(-digits)

    @F.arrow_udf(T.StringType())
    def of(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else str(Decimal(v).quantize(quantum, ROUND_HALF_UP)) for v in values.to_pylist()], pa.string())

    return of


def tile_bbox(z: Column, x: Column, y: Column, wrap: Column) -> dict[str, Column]:
    """West, east, north and south of a web-mercator tile in degrees; the antimeridian isn't treated, a wrap shifts by 360."""
    n = F.pow(F.lit(2.0), z)
    lon = lambda c: c / n * 360 - 180 + wrap * 360
    lat = lambda c: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * c / n))))
    return {"west": lon(x), "east": lon(x + 1), "north": lat(y), "south": lat(y + 1)}


def tile_place(z: Column, lon: Column, lat: Column) -> dict[str, Column]:
    """Where a point in degrees lies in a zoom's square of web-mercator tiles, x and y from 0 to the number of tiles."""
    n = F.pow(F.lit(2.0), z)
    return {"x": (lon + 180) / 360 * n, "y": (1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n}


def tile_of(z: Column, lon: Column, lat: Column) -> dict[str, Column]:
    """The x and y of the tile of a point; what lies outside the square belongs to the tile at its edge."""
    return {k: within_square(F.floor(c), z) for k, c in tile_place(z, lon, lat).items()}


def within_square(tile: Column, z: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.pow(F.lit(2.0), z).cast("long") - 1, tile.cast("long")))
