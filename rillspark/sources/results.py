"""Result files as runs: long Parquet rows, dense NetCDF arrays, one or many files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillspark.constants import VARIABLES
from rillspark.functions import values as V
from rillspark.model import BROADCAST_ROWS, Run, last_writes, run_of
from rillspark.operators.merge import first_seen, merged_cells, one_kind_of_time, union_of_times
from rillspark.sources.listing import SCHEMA, cycle_files
from rillspark.sources.netcdf import NetCdfSource


def canonical(raw: DataFrame, ord_col: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``(feature_id, time, ord, flow, velocity, depth)`` of any table with the first two columns; a missing variable is null.

    Columns are found by name, others but those to ``keep`` are left out and never read.  Rows whose id isn't a number or whose
    time is null are dropped.
    """
    kinds = dict(zip(raw.columns, (f.dataType for f in raw.schema.fields), strict=True))
    values = [V.narrowed(F.col(v)).alias(v) if v in kinds else F.lit(None).cast("float").alias(v) for v in VARIABLES]
    time = V.epoch_ms(F.col("time"), kinds["time"]).alias("time")
    return raw.select(*keep, V.feature_id(F.col("feature_id")).alias("feature_id"), time, ord_col.alias("ord"), *values).filter("feature_id IS NOT NULL AND time IS NOT NULL")


def observed(raw: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """``raw``, read from files, with counts that the first action on it leaves behind: no scan is made for them.

    ``rows`` of all files, those ``rejected`` by ``canonical``, and the ``files`` that have any row and have been read to their first.
    """
    counts = Observation(name) if name else Observation()
    bad = V.feature_id(F.col("feature_id")).isNull() | F.col("time").isNull()
    first = F.col("_metadata.row_index") == 0
    marked = raw.withColumn("_first", first)
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected"), F.count_if("_first").alias("files")]
    return marked.observe(counts, *metrics).drop("_first"), counts


def rejects(raw: DataFrame) -> DataFrame:
    """One row: how many rows ``canonical`` drops."""
    bad = V.feature_id(F.col("feature_id")).isNull() | F.col("time").isNull()
    return raw.agg(F.count_if(bad).alias("rejected"))


def _in_file_order() -> Column:
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def scan_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Canonical rows in the order of the files and of the rows in them."""
    return canonical(spark.read.option("mergeSchema", True).parquet(*paths), _in_file_order())


def load_parquet(spark: SparkSession, path: str) -> Run:
    raw = spark.read.option("mergeSchema", True).parquet(path)
    return run_of(canonical(raw, _in_file_order()), files=(path,), variables=tuple(v for v in VARIABLES if v in raw.columns))


def _dense(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(NetCdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # filters on ids and times reach the arrays
    return spark.read.format("rill_netcdf").options(**options).load()


def load_netcdf(spark: SparkSession, path: str, variables: Sequence[str] = VARIABLES) -> Run:
    """A file's dense arrays, of the variables those wanted.  Axes keep the file's order, doubled ids and times the last cell; times are offsets in seconds."""
    rows = _dense(spark, path=path, variables=",".join(variables))
    cells = rows.groupBy("feature_id", "time").agg(*[F.max_by(v, F.struct("row_idx", "t_idx")).alias(v) for v in VARIABLES])
    features = rows.groupBy("feature_id").agg(F.max("row_idx").alias("row_idx"))
    times = rows.groupBy("time").agg(F.max("t_idx").alias("t_idx"))
    head = rows.select("ref_time", "variables").first()
    valid = [V.valid(F.col(v)).alias(v) for v in VARIABLES]
    there = tuple(v for v in head.variables.split(",") if v in variables) if head and head.variables else VARIABLES
    return Run(cells.select("feature_id", "time", *valid), features, times, "offset_s", head.ref_time if head else None, (path,), there)


def load(spark: SparkSession, path: str) -> Run:
    """By the name's ending: Parquet, else NetCDF."""
    return load_parquet(spark, path) if path.endswith(".parquet") else load_netcdf(spark, path)


def _qualified(spark: SparkSession, path: str) -> str | None:
    """The path in full, as a URI; None if nothing is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return _one_slash(store.makeQualified(there).toUri().toString()) if store.exists(there) else None


def _one_slash(uri: str) -> str:
    """Local files are written with one slash or three."""
    return re.sub("^file:/+", "file:/", uri)


def _with_parents(path: str) -> list[str]:
    names = path.split("/")
    return ["/".join(names[:n]) for n in range(len(names), 0, -1)]


def _many_parquet(spark: SparkSession, paths: list[tuple[int, str]]) -> DataFrame | None:
    """Canonical rows with ``ds`` of all files in one scan.  Files that are gone, damaged or without the columns give no rows."""
    place = {q: ds for ds, p in paths if (q := _qualified(spark, p)) is not None}
    reader = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    try:
        raw = reader.parquet(*place) if place else None
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # no file has a readable footer
            raise
        raw = None
    if raw is None or not {"feature_id", "time"} <= set(raw.columns):
        return None
    files = [(f, place[q]) for f in map(_one_slash, raw.inputFiles()) for q in _with_parents(f) if q in place]
    known = spark.createDataFrame(files, "_file string, ds int")  # a row for each file
    placed = raw.withColumn("_path", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    placed = placed.join(F.broadcast(known) if len(files) <= BROADCAST_ROWS else known, F.regexp_replace("_path", "^file:/+", "file:/") == F.col("_file"))
    return canonical(placed, F.struct("_path", "_row"), keep=["ds"]).withColumn("row_idx", F.col("feature_id"))


def load_many(spark: SparkSession, paths: Iterable[str]) -> Run:
    """All files that can be read, merged in order in one plan; files that can't are skipped, but not all of them.

    A Parquet file has a variable if it has any value of it, a NetCDF file if it has the array.  Files with different kinds of time
    aren't merged.
    """
    paths = list(paths)
    if not paths:
        raise LookupError("no result files")
    parquet = [(i, p) for i, p in enumerate(paths) if p.endswith(".parquet")]
    netcdf = [(i, p) for i, p in enumerate(paths) if not p.endswith(".parquet")]
    kinds = {"epoch_ms": _many_parquet(spark, parquet)} if parquet else {}
    if netcdf:
        rows = _dense(spark, paths=json.dumps(netcdf), skipUnreadable="true")
        kinds["offset_s"] = rows.withColumn("ord", F.struct("row_idx", "t_idx"))
    found, heads = {}, {}
    for kind, rows in kinds.items():
        if rows is not None:
            there = F.col("variables") if "variables" in rows.columns else F.concat_ws(",", *[F.when(F.bool_or(F.col(v).isNotNull()), F.lit(v)) for v in VARIABLES])
            ref = F.first("ref_time") if "ref_time" in rows.columns else F.lit(None).cast("string")
            head = rows.groupBy("ds").agg((F.first(there) if "variables" in rows.columns else there).alias("variables"), ref.alias("ref_time")).orderBy("ds").collect()  # a row for each file
            if head:
                found[kind], heads[kind] = rows, head
    one_kind_of_time(set(found))
    if not found:
        raise LookupError("no result file could be read")
    ((kind, rows),) = found.items()
    head = heads[kind]
    having = {v: [r.ds for r in head if v in r.variables.split(",")] for v in VARIABLES}
    cells = last_writes(rows, by=["ds"]).select("ds", "feature_id", "time", *[V.valid(F.col(v)).alias(v) for v in VARIABLES])
    features = rows.groupBy("ds", "feature_id").agg(F.max("row_idx").alias("row_idx"))
    times = rows.select("ds", "time").distinct()
    files = tuple(paths[r.ds] for r in head)
    return Run(merged_cells(cells, features, times, having), first_seen(features), union_of_times(times), kind, head[0].ref_time, files, tuple(v for v in VARIABLES if having[v]))


@dataclass(frozen=True)
class Cycle:
    """What a cycle's folder gave: the run, the listing ``(ds, region, key, length, problem)``, and the regions that couldn't be listed."""

    run: Run
    listing: DataFrame
    failed: tuple[str, ...]


def load_cycle(spark: SparkSession, cycle: str) -> Cycle:
    """All regions of a cycle as one run: results in the order of the regions' names, then of their keys.

    A result is a file or a folder of Parquet parts, which are rows of one result and never cover each other as results do.

    Regions are listed by a Spark job, one task each.  A region whose listing fails is left out and named, a file that can't be read
    is left out; it is an error if no file is found, or if none can be read.
    """
    listing = cycle_files(spark, cycle)
    rows = sorted(listing.collect(), key=lambda r: (r.ds, r.key or ""))  # a row for each file of a cycle, whose paths a reader takes
    keys = [r.key for r in rows if r.key is not None]
    if not keys:
        raise LookupError(f"no result files in the regions of {cycle}")
    listed = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return Cycle(load_many(spark, keys), listed, tuple(r.region for r in rows if r.problem is not None))


def save(run: Run, path: str) -> None:
    """The cells as long Parquet rows, which ``load`` reads back."""
    run.cells.write.mode("error").parquet(path)
