"""Listing the result files of many regions as a Spark job: a task for each region's folder, a row for each file or failure."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillspark.functions import paths as P
from rillspark.plans.runtree import RESULTS
from rillspark.sources.folders import list_level

SCHEMA = "ds int, region string, key string, length long, problem string"
#: Fixed value: what the names of result files end with.
ENDINGS = (".nc", ".parquet")
#: Names of stores that Arrow calls otherwise.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "hdfs": "hdfs", "file": "file"}


class Region(InputPartition):
    def __init__(self, ds: int, path: str):
        self.ds, self.path = ds, path


def open_store(path: str):
    """Arrow's file system of a path, and the path there."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    return fs.FileSystem.from_uri(ARROW_SCHEMES.get(scheme, scheme) + ":" + rest)


def results_of(found: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """Key and length of the results among files ``(path, length)``, in the order of their keys.

    A folder whose name ends in ``.parquet`` is one result, as it is for ``load``: its visible files are the parts of one table,
    however many wrote it, and their lengths are added.  Of folders within each other the outer one counts.
    """
    lengths: dict[str, int] = {}
    for path, length in found:
        names = path.split("/")
        depth = next((i for i, n in enumerate(names[:-1], 1) if n.endswith(".parquet")), len(names))
        own = names[depth:] or names[-1:]
        if names[depth - 1].endswith(ENDINGS) and not any(n.startswith(".") or n.startswith("_") and "=" not in n for n in own):
            key = "/".join(names[:depth])
            lengths[key] = lengths.get(key, 0) + length
    return sorted(lengths.items())


def files_below(path: str) -> list[tuple[str, int]]:
    """``results_of`` the files at any depth; nothing there is no result, anything else an error."""
    from pyarrow import fs

    store, at = open_store(path.rstrip("/"))
    kind = store.get_file_info(at).type
    if kind == fs.FileType.NotFound:
        return []
    if kind == fs.FileType.File:
        raise NotADirectoryError(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    results = results_of((f.path[len(at) + 1 :], f.size) for f in found if f.type == fs.FileType.File)
    return [(f"{path.rstrip('/')}/{key}", length) for key, length in results]


class RegionReader(DataSourceReader):
    """A partition for each region.  A listing that fails is a row with its ``problem`` and no key, and so is not an error of the job."""

    def __init__(self, regions: list[tuple[int, str]]):
        self.regions = regions

    def partitions(self) -> list[InputPartition]:
        return [Region(ds, path) for ds, path in self.regions]

    def read(self, partition: Region) -> Iterator[tuple]:
        try:
            files = files_below(partition.path.rstrip("/") + "/" + RESULTS)
        except (OSError, ValueError) as e:  # Arrow's own errors are of these kinds
            yield partition.ds, partition.path, None, None, f"{type(e).__name__}: {e}"
            return
        for key, length in files:
            yield partition.ds, partition.path, key, length, None


class RegionSource(DataSource):
    """Option ``regions``: a JSON list of numbers and folders."""

    @classmethod
    def name(cls) -> str:
        return "rill_regions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RegionReader:
        return RegionReader([(int(i), p) for i, p in json.loads(self.options["regions"])])


def region_files(spark: SparkSession, regions: list[tuple[int, str]]) -> DataFrame:
    """``(ds, region, key, length, problem)`` of numbered region folders; a region without files has no row."""
    spark.dataSource.register(RegionSource)
    return spark.read.format("rill_regions").option("regions", json.dumps(regions)).load()


def cycle_files(spark: SparkSession, cycle: str) -> DataFrame:
    """``region_files`` of the regions of a cycle's folder, numbered in the order of their names."""
    level = list_level(spark, cycle).filter(F.col("is_folder") & P.is_vpu(F.col("name"))).orderBy("name").collect()  # one folder's children
    return region_files(spark, [(i, r.path) for i, r in enumerate(level)])
