"""Names and classes in a tree of run folders ``outputs/<model>/<x>_hydrofabric/ngen.YYYYMMDD/<range>/<cycle>/[member/]VPU_*/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "/+$", ""), "/")


def name_of(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def parent_of(path: Column) -> Column:
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), F.lit("/"))).otherwise(F.lit(""))


def is_date(name: Column) -> Column:
    return name.rlike(r"\d{8}")


def is_range(name: Column) -> Column:
    return name.rlike("(?i)_range$") | name.rlike("(?i)^analysis")


def is_cycle(name: Column) -> Column:
    return name.rlike(r"^\d+$")


def is_vpu(name: Column) -> Column:
    return name.rlike("(?i)^VPU[_-]")


def is_clicked_vpu(name: Column) -> Column:
    """The stricter test of a selected folder: upper case and an underscore only."""
    return F.get(F.split(name, "_"), F.lit(0)) == "VPU"


def is_hydrofabric(name: Column) -> Column:
    return name.rlike("(?i)_hydrofabric$")


def date_key(name: Column) -> Column:
    """The first run of eight digits as a number, 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"(\d{8})", 1).try_cast("int"), F.lit(0))


def is_result_file(key: Column) -> Column:
    return key.endswith(".nc") | key.endswith(".parquet")


def deep_link(base: Column, bucket: Column, path: Column) -> Column:
    return F.concat(base, F.lit("?bucket="), F.url_encode(bucket), F.lit("&path="), F.url_encode(path))


def from_deep_link(url: Column) -> dict[str, Column]:
    return {k: F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(k))) for k in ("bucket", "path")}
