"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.sources.shared import fresh_path

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def give_back() -> None:
    """Give freed memory back to the system: Python workers outlive tasks, and one that waits would go on holding it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of the Arrow batches that go to Python workers and come back: both sides hold a task's batch, and buffers grow by doubling.
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have no more than ``ARROW_BYTES`` bytes, or one row; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, its shuffles go and no executor's loss undoes it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with shuffles_end(spark):
        df.write.parquet(path)
    if _scratch:
        _scratch[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_scratch: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end, when what is read from then on has been written outside."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            _delete(spark, path)


@contextmanager
def outside() -> Iterator[None]:
    """Within ``scratch``: what ``cut`` writes here belongs to the caller and stays."""
    own = _scratch.pop()
    try:
        yield
    finally:
        _scratch.append(own)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by ``cut`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Hash functions of a Bloom filter, the bits that it has for each key, and the fewest and most in all: 16 MB on the driver and in a
#: task, for some eight million keys.  With more it lets more and more others pass, which costs work later on and changes no result.
BLOOM_HASHES, BLOOM_BITS_A_KEY, BLOOM_LEAST, BLOOM_MOST = 4, 16, 1 << 16, 1 << 27


class Bloom:
    """A filter of keys, made of DataFrame operations: what it refuses is no key for certain.

    It has as many bits as the counted rows of ``keys`` ask for, or ``bits``.  These are words of 64 in one array, the value of a scalar subquery, which a row looks up in without leaving the JVM.
    """

    def __init__(self, keys: DataFrame, *columns: str, bits: int | None = None, label: str = "bloom"):
        if bits is None:
            bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_BITS_A_KEY * keys.count()).bit_length()))
        self.bits = bits
        at = keys.select(F.explode(F.array(*self._spots(columns))).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
        words = at.groupBy("word").agg(F.bit_or("bit").alias("bit"))
        every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
        words = words.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bit"))
        ordered = F.sort_array(F.collect_list(F.struct("word", "bit")))  # bits / 64 words
        self.words = cut(words.agg(F.transform(ordered, lambda x: x["bit"]).alias("words")), label)

    def _spots(self, columns: tuple[str, ...]) -> list[Column]:
        # Hashes below 2^40, so that no sum overflows.
        first, second = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) for seed in ("bloom", "filter"))
        return [F.pmod(first + F.lit(i) * second, F.lit(self.bits)) for i in range(BLOOM_HASHES)]

    def may_have(self, *columns: str) -> Column:
        words = self.words.scalar()
        word = lambda at: F.get(words, F.shiftright(at, 6).cast("int"))
        is_set = lambda at: F.getbit(word(at), at.bitwiseAND(F.lit(63)).cast("int")) == 1
        return reduce(and_, [is_set(at) for at in self._spots(columns)])


#: Rows of a key that one task of a join may have, and bits of the filter of the keys with more.
SPREAD_ROWS, SPREAD_BITS = 1 << 20, 1 << 20


def spread_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", label: str = "spread") -> DataFrame:
    """``rows`` joined with ``side``, which has a row or none for each value of ``key``; no key's rows are all one task's.

    If a key has over ``SPREAD_ROWS`` rows, ``side``'s row of it stands in as many parts as the largest such key needs, and each of
    ``rows`` looks in one of them, told by a hash of its columns.  Both sides ask the same filter which keys these are, so a key
    that it takes for one by mistake is spread on both and finds its row.  Null keys match nothing; rows equal in every column
    share a part.
    """
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPREAD_ROWS), f"{label}-hot")
    largest = hot.agg(F.max("n")).first()[0]
    if largest is None:
        return rows.join(side, key, how)
    parts, part = -(-largest // SPREAD_ROWS), free_name(rows, "_part")
    is_hot = Bloom(hot, key, bits=SPREAD_BITS, label=f"{label}-filter").may_have(key)
    own = F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn(part, own).join(side.withColumn(part, F.explode(every)), [key, part], how).drop(part)


def chosen_rows(rows: DataFrame, names: tuple[str, ...], chosen: DataFrame, others: DataFrame, label: str) -> DataFrame:
    """The rows whose columns ``names`` are among ``chosen``, of rows that are all among ``chosen`` or ``others``; all columns stay.

    ``chosen`` has the columns ``names`` and ``copies``, the number of rows with them; of several one stays.  A first filter has
    the others' keys and those of several rows.  A second one has the chosen keys that the first lets pass.  A row that the first
    refuses is chosen, one that only the second refuses isn't, and what both let pass is joined with the chosen keys.  So the
    rows, texts and all, are shuffled only where that can't be told, whatever part of them is chosen.
    """
    keys = list(names)
    first = Bloom(others.select(*keys).unionByName(chosen.filter("copies > 1").select(*keys)), *keys)
    left_open = cut(chosen.filter(first.may_have(*keys)).select(*keys, "copies"), f"{label}-open")
    if left_open.isEmpty():
        return rows.filter(~first.may_have(*keys))
    second = Bloom(left_open, *keys)
    one, two = free_name(rows, "_first"), free_name(rows, "_second")
    marked = rows.withColumn(one, first.may_have(*keys)).withColumn(two, second.may_have(*keys))
    sure = marked.filter(~F.col(one)).drop(one, two)
    settled = marked.filter(F.col(one) & F.col(two)).drop(one, two)
    renamed = {k: free_name(rows, f"_of_{k}") for k in keys}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    settled = settled.join(left_open.select(*[F.col(k).alias(r) for k, r in renamed.items()]), same, "left_semi")
    if not left_open.filter("copies > 1").isEmpty():
        settled = settled.dropDuplicates(keys)
    return sure.unionByName(settled)
