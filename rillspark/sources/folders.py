"""Listing result files in a store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_keys(spark: SparkSession, root: str, pattern: str = "*.{nc,parquet}") -> DataFrame:
    """``(key, length, modified)`` of the files below ``root``; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("key"), "length", F.col("modificationTime").alias("modified"))


def list_level(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, path, is_folder, length)`` of what stands directly in ``folder``: one listing of that level, nothing below it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)
    rows = [(s.getPath().getName(), s.getPath().toString() + ("/" if s.isDirectory() else ""), s.isDirectory(), s.getLen()) for s in found]
    return spark.createDataFrame(sorted(rows), "name string, path string, is_folder boolean, length long")
