"""Views of the star schema's tables as inputs of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.model import Run, run_of
from rillspark.plans.runtree import RESULTS
from rillspark.sources.results import canonical
from rillspark.sources.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Events as long result rows: users are features, event types choose the variable, ids order the rows."""
    of = lambda *types: F.when(F.col("event_type").isin(*types), F.col("value"))
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("feature_id"),
        F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz").alias("time"),
        "event_id",
        of("view", "click").alias("flow"),
        of("purchase").alias("velocity"),
        of("signup").alias("depth"),
    )
    return canonical(raw, F.col("event_id"))


def event_run(spark: SparkSession, sf_dir: str, unit: str = "day") -> Run:
    return run_of(event_rows(spark, sf_dir, unit))


def _split(rows: DataFrame) -> list[DataFrame]:
    part = F.when((F.col("feature_id") % 3 == 2) & (F.col("ord") % 2 == 0), 0).when(F.col("ord") % 3 == 0, 1).otherwise(2)
    return [rows.filter(part == i) for i in range(3)]


def split_runs(spark: SparkSession, sf_dir: str) -> list[Run]:
    """Three runs with overlapping features and times."""
    return [run_of(rows) for rows in _split(event_rows(spark, sf_dir))]


def split_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The same three as result files, a fresh folder in the shared one each time."""
    base = fresh_path(spark, "results")
    paths = [f"{base}/part-{i}.parquet" for i in range(3)]
    for path, rows in zip(paths, _split(event_rows(spark, sf_dir)), strict=True):
        rows.orderBy("ord").drop("ord").write.parquet(path)
    return paths


def run_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The same three as one file each for a stream, written one after the other."""
    for rows in _split(event_rows(spark, sf_dir)):
        stamped = rows.withColumn("time", F.timestamp_millis("time"))
        stamped.select("feature_id", "time", "ord", "flow", "velocity", "depth").coalesce(1).write.mode("append").parquet(folder)


def cycle_folder(spark: SparkSession, sf_dir: str) -> str:
    """A cycle's folder in the shared one: the three as regions, a damaged file beside the second's, and two more regions, of which one can't be listed and one is empty."""
    base = f"{fresh_path(spark, 'tree')}/outputs/m/v2.2_hydrofabric/ngen.20240101/short_range/06"
    for i, rows in enumerate(_split(event_rows(spark, sf_dir))):
        rows.orderBy("ord").drop("ord").write.parquet(f"{base}/VPU_0{i + 1}/{RESULTS}part.parquet")
    damaged_file(spark, f"{base}/VPU_02/{RESULTS}part.parquet")
    nothing = spark.range(0)
    nothing.write.parquet(f"{base}/VPU_05/other")
    nothing.write.parquet(f"{base}/VPU_06/other")
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/VPU_05/{RESULTS}".rstrip("/"))
    there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there).close()  # a file where the folder should be
    return base


def rejected_files(spark: SparkSession, sf_dir: str) -> str:
    """All events as result files, of which those of one type lack an id and those of an early hour a time; a file for each user's remainder by four."""
    rows = event_rows(spark, sf_dir).withColumn("part", F.col("feature_id") % 4)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    rows = rows.join(events, F.col("ord") == F.col("event_id"))
    broken = rows.withColumn("feature_id", F.when(F.col("event_type") != "error", F.col("feature_id"))).withColumn("time", F.when(F.hour("ts") >= 2, F.col("time")))
    path = fresh_path(spark, "rejected")
    broken.select("part", "feature_id", "time", "flow", "velocity", "depth").repartition("part").write.partitionBy("part").parquet(path)
    return path


def damaged_file(spark: SparkSession, beside: str) -> str:
    """A file that only its name makes Parquet."""
    path = f"{beside.rsplit('/', 1)[0]}/damaged.parquet"
    spark.range(1).select(F.lit("no columns here").alias("value")).coalesce(1).write.text(path)
    return path


def divides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as a nested set: a region stands before its nations."""
    nations = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    sizes = nations.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("r_regionkey").rowsBetween(Window.unboundedPreceding, -1)  # five regions
    regions = (
        table(spark, sf_dir, "region")
        .join(sizes, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .select("r_regionkey", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("upstream_id", 1 + F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    )
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    leaves = nations.withColumn("rank", rank).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return regions.select("upstream_id", F.col("n").alias("num_upstreams")).unionByName(leaves.select((F.col("upstream_id") + F.col("rank")).alias("upstream_id"), F.lit(0).cast("long").alias("num_upstreams")))


def flowpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line, or for every third customer two, with places made of the key."""
    k = F.col("c_custkey")
    point = lambda a, b: F.struct((F.pmod(k * a, F.lit(3600)) / 10 - 180).alias("x"), (F.pmod(k * b, F.lit(1600)) / 10 - 80).alias("y"))
    line, second = F.array(point(37, 53), point(41, 59)), F.array(point(43, 61), point(47, 67))
    lines = F.when(k % 3 == 0, F.array(line, second)).otherwise(F.array(line))
    properties = F.create_map(F.lit("id"), k.cast("string"), F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(k.alias("feature_id"), lines.alias("coordinates"), properties.alias("properties"))


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key)`` of a file for each event, in the run tree of one of four models; types of events are ranges, users are regions."""
    user, id_ = F.col("user_id"), F.col("event_id")
    range_ = F.element_at(F.create_map(*[F.lit(x) for pair in RANGE_OF.items() for x in pair]), F.col("event_type"))
    hour = F.lpad((F.hour("ts") - F.hour("ts") % 6).cast("string"), 2, "0")
    member = F.when(range_ == "medium_range", F.concat((user % 2 + 1).cast("string"), F.lit("/"))).otherwise(F.lit(""))
    vpu = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("VPU_", "VPU-", "vpu_")]), (user % 3 + 1).cast("int")), F.lpad((user % 21).cast("string"), 2, "0"))
    file = F.element_at(F.array(*[F.lit(x) for x in ("troute.nc", "part.parquet", "log.txt")]), (id_ % 3 + 1).cast("int"))
    key = F.format_string(
        "outputs/m%d/v2.2_hydrofabric/ngen.%s/%s/%s/%s%s/ngen-run/outputs/troute/%s", user % 4, F.date_format("ts", "yyyyMMdd"), range_, hour, member, vpu, file
    )
    return table(spark, sf_dir, "events").select(key.alias("key")).distinct()


RANGE_OF = {"view": "short_range", "click": "Short_Range", "purchase": "medium_range", "signup": "analysis_assim_extend", "error": "logs"}


def asked_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, range_key)``: where customers stand in that tree, from a model down to a region, each asking for three ranges and one that isn't there."""
    k = F.col("c_custkey")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", "/v2.2_hydrofabric", "/v2.2_hydrofabric/ngen.20240101/short_range", "/v2.2_hydrofabric/ngen.20240101/medium_range/00/1/VPU_01/")]), (k % 4 + 1).cast("int"))
    keys = F.explode(F.array(*[F.lit(x) for x in ("short", "medium", "analysis", "long")]))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("outputs/m"), (k % 5).cast("string"), tail).alias("path"), keys.alias("range_key")).distinct()
