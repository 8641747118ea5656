"""Result rows that keep arriving: last values, a running merge of runs, and tiles to paint once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rillspark.constants import VARIABLES
from rillspark.functions import values as V
from rillspark.model import Run, run_of
from rillspark.operators.merge import merge

ROWS = T.StructType(
    [T.StructField("feature_id", T.LongType()), T.StructField("time", T.TimestampType()), T.StructField("ord", T.LongType())]
    + [T.StructField(v, T.FloatType()) for v in VARIABLES]
)


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that appear in a folder; a file that can't be read is skipped."""
    return spark.readStream.schema(ROWS).option("ignoreCorruptFiles", True).parquet(folder)


def latest_cells(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """The last value of each variable by feature and time; state ends ``lateness`` after a time was last current."""
    last = [V.valid(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ord")))).alias(v) for v in VARIABLES]
    return rows.withWatermark("time", lateness).groupBy("feature_id", "time").agg(*last)


def arrivals(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each (feature, time) once, however often it arrives."""
    return rows.withWatermark("time", lateness).dropDuplicatesWithinWatermark(["feature_id", "time"])


def append_cells(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the rows to a folder of long rows exactly once; ``load`` gives the last writes."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``read_rows`` a file at a time, oldest first: each file is a run of its own."""
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def _stored(spark: SparkSession, folder: str, version: int) -> Run:
    cells, features, times = (spark.read.parquet(f"{folder}/{version}/{part}") for part in ("cells", "features", "times"))
    return Run(cells, features, times)


def running_merge(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Merge the run of each batch into those before it, by the rule of ``merge``; ``merged_so_far`` reads what there is.

    Merging the merged run with the next one gives what merging all at once would: the next one covers a cell where its axes have
    both feature and time, whatever the cells are.  A batch writes the version of its number from the one before, so a batch that
    is run again after a failure writes the same once more.
    """
    spark = rows.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        times = batch.withColumn("time", V.epoch_ms(F.col("time"), T.TimestampType()))
        run = run_of(times)
        merged = run if number == 0 else merge([_stored(spark, target, number - 1), run])
        for part in ("cells", "features", "times"):
            getattr(merged, part).write.mode("overwrite").parquet(f"{target}/{number}/{part}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_so_far(spark: SparkSession, target: str) -> Run:
    """The newest version that is complete: its last part, the times, has been written."""
    store = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = store.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted((int(s.getPath().getName()) for s in files.listStatus(store) if s.getPath().getName().isdigit()), reverse=True)
    for number in numbers:
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{number}/times/_SUCCESS")):
            return _stored(spark, target, number)
    raise LookupError(f"no merged run in {target}")


TILES = "key string, arrivals long, first_time timestamp, expired boolean"


class TilesOnce(StatefulProcessor):
    """For each tile's key: passed on when it first arrives, counted while it is waited for, and reported when it ends.

    A timer ends a key's state so many milliseconds after its first arrival, in event time; a tile that comes again after that is
    new, however the arrivals are dealt to batches.
    """

    def __init__(self, waits_ms: int):
        self.waits_ms = waits_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("arrivals", T.LongType()), T.StructField("first_ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrivals, first = self.seen.get() if self.seen.exists() else (0, None)
        for t in sorted(int(t.timestamp() * 1000) for r in rows for t in r["time"]):
            if first is None or t >= first + self.waits_ms:  # the timer may not have been told yet
                if first is not None:
                    self.handle.deleteTimer(first + self.waits_ms)
                    yield self._row(key, arrivals, first, True)
                arrivals, first = 0, t
                self.handle.registerTimer(first + self.waits_ms)
                yield self._row(key, 1, first, False)
            arrivals += 1
        self.seen.update((arrivals, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        arrivals, first = self.seen.get()
        self.seen.clear()
        yield self._row(key, arrivals, first, True)

    def _row(self, key, arrivals: int, first: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "arrivals": [arrivals], "first_time": [pd.Timestamp(first, unit="ms")], "expired": [expired]})

    def close(self) -> None:
        pass


def tiles_once(arrivals: DataFrame, waits: int = 60_000, lateness: str = "10 seconds") -> DataFrame:
    """``(key, arrivals, first_time, expired)`` of a stream ``(key, time)``: a row when a tile first arrives and one when its state ends.

    The state of a key is two numbers; it ends by a timer in event time, so there are as many keys as tiles of the last ``waits``
    milliseconds.  Needs the RocksDB state store.
    """
    known = arrivals.filter("key IS NOT NULL AND time IS NOT NULL").withWatermark("time", lateness)
    return known.groupBy("key").transformWithStateInPandas(statefulProcessor=TilesOnce(waits), outputStructType=TILES, outputMode="Append", timeMode="EventTime")
