"""A run stored by time: the cells in folders of time buckets, in each by feature, the axes beside them.

A slice reads one bucket's folder.  New cells replace whole buckets and leave the others as they are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.constants import VARIABLES
from rillspark.model import BROADCAST_ROWS, Run

DAY_MS = 86_400_000
CELLS = "feature_id long, time long, " + ", ".join(f"{v} float" for v in VARIABLES) + ", bucket long"
#: Rows of a file; a bucket of more has several, each of a range of features.
FILE_ROWS = 4_000_000


def _bucketed(cells: DataFrame, bucket: int) -> DataFrame:
    """Cells dealt by bucket and range of features, sorted by feature within: no bucket is one task's."""
    rows = cells.withColumn("bucket", F.floor(F.col("time") / bucket).cast("long"))
    return rows.repartitionByRange("bucket", "feature_id", "time").sortWithinPartitions("bucket", "feature_id", "time")


def save_by_time(run: Run, path: str, bucket: int = DAY_MS) -> None:
    """A new store at ``path`` with buckets of so many of the run's units of time."""
    _bucketed(run.cells, bucket).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").mode("error").parquet(f"{path}/cells")
    _save_axes(run, path, bucket)


def _save_axes(run: Run, path: str, bucket: int) -> None:
    run.features.write.mode("overwrite").parquet(f"{path}/features")
    run.times.write.mode("overwrite").parquet(f"{path}/times")
    head = {"bucket": bucket, "time_kind": run.time_kind, "ref_time": run.ref_time, "variables": run.variables, "files": run.files}
    run.cells.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def replace_buckets(run: Run, merged: Run, path: str) -> None:
    """Write the buckets that ``run`` has any time in from ``merged``, a run of old and new cells; the other buckets' files stay.

    The axes written are ``merged``'s.  ``merged`` must not read the buckets that are replaced: write it elsewhere first.
    """
    bucket = head_of(run.cells.sparkSession, path)["bucket"]
    number = F.floor(F.col("time") / bucket).cast("long").alias("bucket")
    touched = run.times.select(number).distinct()
    touched = F.broadcast(touched) if run.n_times <= BROADCAST_ROWS else touched
    cells = merged.cells.select("*", number).join(touched, "bucket", "left_semi").drop("bucket")
    kept = _bucketed(cells, bucket).write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
    kept.partitionBy("bucket").mode("overwrite").parquet(f"{path}/cells")
    _save_axes(merged, path, bucket)


def head_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/head").first().value)


def load_by_time(spark: SparkSession, path: str) -> Run:
    """The run of a store; its slices filter on the bucket, so that only that folder is listed and read."""
    head = head_of(spark, path)
    cells = spark.read.schema(CELLS).parquet(f"{path}/cells")
    plain = cells.drop("bucket")

    def at(time: int) -> DataFrame:
        return cells.filter((F.col("bucket") == time // head["bucket"]) & (F.col("time") == time)).drop("bucket")

    axes = [spark.read.parquet(f"{path}/{axis}") for axis in ("features", "times")]
    return Run(plain, *axes, head["time_kind"], head["ref_time"], tuple(head["files"]), tuple(head["variables"]), at)
