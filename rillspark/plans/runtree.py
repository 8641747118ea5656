"""Browsing trees of run folders given as a table of keys: every question is one plan over all folders at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions import paths as P
from rillspark.sources.shared import written

#: Fixed value: the deepest level that the search for dated runs goes down to.
MAX_DEPTH = 6
RESULTS = "ngen-run/outputs/troute/"


def folders_of(keys: DataFrame) -> DataFrame:
    """``(path, name, parent)`` of every folder above a key ``(key)``; at the top the parent is empty."""
    parts = F.split("key", "/")
    at = keys.select(parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")).filter(F.size("parts") > 1)
    path = F.concat(F.array_join(F.slice("parts", 1, F.col("n")), "/"), F.lit("/"))
    return at.select(path.alias("path")).distinct().select("path", P.name_of(F.col("path")).alias("name"), P.parent_of(F.col("path")).alias("parent"))


def listed(folders: DataFrame) -> DataFrame:
    """``(parent, position, name, path)``: every folder's children in the order shown, by name, newest first below a hydrofabric folder."""
    forwards = Window.partitionBy("parent").orderBy("name")
    backwards = Window.partitionBy("parent").orderBy(F.col("name").desc())
    newest_first = P.is_hydrofabric(P.name_of(F.col("parent")))
    position = F.when(newest_first, F.row_number().over(backwards)).otherwise(F.row_number().over(forwards)) - 1
    return folders.select("parent", position.alias("position"), "name", "path")


def children(keys: DataFrame, prefix: str) -> DataFrame:
    """``(parent, name, path)`` of the folders directly below ``prefix``, of keys ``(key)`` that lie below them."""
    below = keys.filter(F.col("key").startswith(prefix)).select(F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key")).alias("rest"))
    names = below.filter(F.instr("rest", "/") > 0).select(F.split("rest", "/")[0].alias("name")).distinct()
    return names.select(F.lit(prefix).alias("parent"), "name", F.concat(F.lit(prefix), "name", F.lit("/")).alias("path"))


def list_folders(keys: DataFrame, prefix: str) -> DataFrame:
    """``(position, name, path)`` of one folder's children."""
    return listed(children(keys, prefix)).select("position", "name", "path")


def classified(folders: DataFrame) -> DataFrame:
    n = F.col("name")
    tests = {"is_date": P.is_date(n), "is_range": P.is_range(n), "is_cycle": P.is_cycle(n), "is_vpu": P.is_vpu(n)}
    return folders.select("path", "name", *[t.alias(k) for k, t in tests.items()], P.date_key(n).alias("date_key"))


def is_cycle_level(folders: DataFrame) -> DataFrame:
    """For each parent whether it has children and all of them are VPU folders: where all regions can be loaded at once."""
    return folders.groupBy("parent").agg(F.bool_and(P.is_vpu(F.col("name"))).alias("is_cycle_level"))


def result_files(keys: DataFrame) -> DataFrame:
    """``(region, name, key)`` of the result files of all regions, at any depth below their folder of results."""
    below = keys.filter(P.is_result_file(F.col("key")) & (F.instr("key", f"/{RESULTS}") > 0))
    region = F.concat(F.substring_index("key", f"/{RESULTS}", 1), F.lit("/"))
    return below.select(region.alias("region"), P.name_of(F.col("key")).alias("name"), "key")


def only_files(files: DataFrame) -> DataFrame:
    """``(region, key)`` where there is nothing to ask: the regions with a single file."""
    found = files.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    return found.filter("n = 1").select("region", "key")


def only_file(files: DataFrame) -> str | None:
    """The key to choose without asking: that of the only file."""
    rows = files.limit(2).collect()
    return rows[0].key if len(rows) == 1 else None


def start_of(path: Column) -> Column:
    """The path without its run-specific tail: dates, ranges, cycles and regions at its end go, two segments stay."""
    parts = P.segments(path)
    specific = lambda n: P.is_date(n) | P.is_range(n) | P.is_cycle(n) | P.is_vpu(n)
    lasting = F.filter(F.transform(parts, lambda n, i: F.when(~specific(n), i + 1)), lambda i: i.isNotNull())
    keep = F.greatest(F.lit(2), F.coalesce(F.array_max(lasting), F.lit(0)))
    return F.concat(F.array_join(F.slice(parts, 1, keep), "/"), F.lit("/"))


def levels(shown: DataFrame) -> DataFrame:
    """What the search has to know of each folder with children, of what ``listed`` gives, one row each.

    ``ranges``: whether any child is a range.  ``next``: where to go on from there, the newest date (of equal ones that shown last),
    else the last hydrofabric folder, else the last.  ``numbered``: the child of the highest number.  ``regions``: whether any child is one.
    """
    n = F.col("name")
    number = F.when(P.is_cycle(n), n.try_cast("decimal(38,0)"))
    newest = F.max_by("path", F.when(P.is_date(n), F.struct(P.date_key(n), "position")))
    fabric = F.max_by("path", F.when(P.is_hydrofabric(n), n))
    return shown.groupBy("parent").agg(
        F.bool_or(P.is_range(n)).alias("ranges"),
        F.coalesce(newest, fabric, F.max_by("path", "name")).alias("next"),
        F.max_by("path", F.when(number.isNotNull(), F.struct(number, "position"))).alias("numbered"),
        F.bool_or(P.is_vpu(n)).alias("regions"),
    )


def latest_cycles(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(path, range_key, latest, problem)`` for each of ``wanted`` ``(path, range_key)``: the folder of the newest run.

    From the path's start a recursive table expression goes down to the folder with the ranges; then come the first range shown
    whose name begins with the key, its highest cycle, and that cycle's highest member unless it has regions itself.  Where one of
    these isn't there, ``latest`` is null and ``problem`` says so.  A start's walk is a row for each level, so ``wanted`` may have
    some 140 000 different starts before Spark's own limit of a million rows of recursion ends the query with an error.
    """
    spark = keys.sparkSession
    everything = written(listed(folders_of(keys)), "folders")
    known = written(levels(everything), "levels")
    asked = written(wanted.select("path", "range_key", start_of(F.col("path")).alias("start")).distinct(), "asked")
    stops = spark.sql(
        f"""
        WITH RECURSIVE walk(start, at, depth) AS (
          SELECT start, start, 0 FROM (SELECT DISTINCT start FROM {{asked}})
          UNION ALL
          SELECT walk.start, l.next, walk.depth + 1 FROM walk JOIN {{known}} l ON l.parent = walk.at WHERE NOT l.ranges AND walk.depth < {MAX_DEPTH}
        )
        SELECT walk.start, walk.at FROM walk JOIN {{known}} l ON l.parent = walk.at WHERE l.ranges
        """,
        asked=asked,
        known=known,
    )
    stops = written(stops, "stops")
    shown = everything.join(stops, F.col("parent") == F.col("at"), "left_semi").select(F.col("parent").alias("at"), "position", F.lower("name").alias("name"), F.col("path").alias("child"))
    there = asked.join(stops, "start", "left")
    keys_of = there.select("at", "range_key").distinct().join(shown, "at").filter(F.col("name").startswith(F.col("range_key")))
    ranges = keys_of.groupBy("at", "range_key").agg(F.min_by("child", "position").alias("range"))
    below = lambda name: known.select(F.col("parent").alias(name), F.col("numbered").alias(f"{name}_numbered"), F.col("regions").alias(f"{name}_regions"))
    found = there.join(ranges, ["at", "range_key"], "left").join(below("range"), "range", "left").withColumnRenamed("range_numbered", "cycle").join(below("cycle"), "cycle", "left")
    latest = F.when(F.coalesce("cycle_regions", F.lit(False)), F.col("cycle")).otherwise(F.coalesce("cycle_numbered", "cycle"))
    problem = (
        F.when(F.col("at").isNull(), F.concat(F.lit("no dated run folders below "), "path"))
        .when(F.col("range").isNull(), F.concat(F.lit("no "), "range_key", F.lit(" range in the latest run")))
        .when(F.col("cycle").isNull(), F.concat(F.lit("no cycles below "), "range"))
    )
    return found.select("path", "range_key", latest.alias("latest"), problem.alias("problem"))


def latest_cycle(keys: DataFrame, path: str, range_key: str) -> str:
    """The folder of the newest run of one range; an error if there is none."""
    found = latest_cycles(keys, keys.sparkSession.createDataFrame([(path, range_key)], "path string, range_key string")).first()
    if found.problem:
        raise LookupError(found.problem)
    return found.latest
