"""Importance resampling: texts are drawn by the ratio of two hashed n-gram models, of a target set and of all texts.

After Xie et al., "Data selection for language models via importance resampling": each model is a distribution over hashed
word unigrams and bigrams; a text's weight is the difference of its log probabilities; the Gumbel top-k of the weights is a
sample without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bloom, cut, free_name, read_table

#: Hash buckets of the models, and the count that every bucket has before any text.
BUCKETS, PRIOR = 10_000, 1.0
#: n-grams of a text that are hashed at a time.
CHUNK = 1 << 20
#: Bins that the k-th largest key is looked for in at a time, and keys that are ranked outright.
BINS, FEW = 1024, 10_000


def gram_buckets(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of the words, lower-cased A-Z, and of neighbouring pairs."""
    words = text.lower().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B1) ^ one[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(16) if len(one) > 1 else one[:0]
    return np.concatenate((one % np.uint64(buckets), two % np.uint64(buckets))).astype(np.int64)


def count_grams(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Counts over all texts; a row for each bucket comes to the driver."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in rows:
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    total += np.bincount(gram_buckets(text.as_py(), buckets), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    p, q = target + prior, raw + prior
    return np.log(p / p.sum()) - np.log(q / q.sum())


def log_weight(ratio: np.ndarray):
    """The column function of a text: its log importance weight, 0 for a null text or one without words."""

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        return pa.array([float(ratio[gram_buckets(t, len(ratio))].sum()) for t in text.cast(pa.binary()).fill_null(b"").to_pylist()], pa.float64())

    return of


def gumbel(*key: Column) -> Column:
    """Standard Gumbel noise by a hash of the row's key, the same in every run."""
    u = (F.pmod(F.xxhash64(F.lit("gumbel"), *key), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[float, int]:
    """The k-th largest value, 1 being the largest, and how many with it are among the k largest, of rows that stand for ``n`` each.

    Histograms of ``BINS`` bins narrow the range until few rows are left or all are the same.
    """
    now = rows.select(F.col(column).cast("double").alias("value"), "n")
    while True:
        low, high, count = now.agg(F.min("value"), F.max("value"), F.count(F.lit(1))).first()
        if low == high:
            return low, k
        if count <= FEW:
            for value, n in sorted(((r.value, r.n) for r in now.groupBy("value").agg(F.sum("n").alias("n")).collect()), reverse=True):  # FEW rows at most
                if k <= n:
                    return value, k
                k -= n
            raise ValueError("there are fewer rows than that")
        bin_of = F.least(F.floor((F.col("value") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        counts = {r.bin: r.n for r in now.groupBy(bin_of.alias("bin")).agg(F.sum("n").alias("n")).collect()}  # BINS rows
        for chosen in sorted(counts, reverse=True):
            if k <= counts[chosen]:
                break
            k -= counts[chosen]
        now = now.filter(bin_of == chosen)


def how_many(rows: DataFrame, k: int) -> Column:
    """How many of the ``n`` that a row stands for are among the k of the largest ``key``; of ties those of the largest ``tie``."""
    if k <= 0 or rows.isEmpty():
        return F.lit(0)
    key, left = kth_largest(rows, "key", k)
    tie, left = kth_largest(rows.filter(F.col("key") == key), "tie", left)
    of_ties = F.when(F.col("tie").cast("double") > tie, F.col("n")).when(F.col("tie").cast("double") == tie, F.least("n", F.lit(left)))
    return F.when(F.col("key") > key, F.col("n")).when(F.col("key") == key, of_ties).otherwise(F.lit(0))


def resample(docs: DataFrame, target: DataFrame, share: float | None = None, k: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, log_weight, key, kept)``, a row for each row of ``docs``; k rows, or a share of all, are kept.

    Rows whose keys tie at the threshold are cut by a hash of id and weight; of rows that are equal in all this as many stay as
    there is room for.  Null and empty texts have weight 0.  An empty target leaves all weights to the prior; an empty table
    gives an empty one.  Texts of any length are hashed whole; other columns are left out, so their names can't clash.
    """
    ratio = log_ratio(count_grams(target, buckets=buckets), count_grams(docs, buckets=buckets))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), log_weight(ratio)(F.col("text").cast("string")).alias("log_weight"))
    scored = scored.groupBy("doc_id", "log_weight").agg(F.count(F.lit(1)).alias("n"))
    tie = F.pmod(F.xxhash64("doc_id", "log_weight"), F.lit(1 << 52))
    keyed = cut(scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"))).withColumn("tie", tie), "importance-keys")
    if k is None:
        k = round((1.0 if share is None else share) * (keyed.agg(F.sum("n")).first()[0] or 0))
    copies = keyed.withColumn("among", how_many(keyed, k)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select("doc_id", "log_weight", "key", (F.col("copy") <= F.col("among")).alias("kept"))


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``, in the same way at every size.

    A Bloom filter of the ids goes first, so that only the texts of those are shuffled, and a few others; the join settles it.
    """
    key = free_name(docs, "_key")
    wanted = ids.select(F.col("doc_id").cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    likely = docs.withColumn(key, F.col("doc_id").cast("long")).filter(Bloom(wanted, key).may_have(key))
    return likely.join(wanted.hint("merge"), key, "left_semi").drop(key)


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are documents of quality 1; as many are kept as that share of the labelled ones says.

    A document with several labels has the largest; labels without an id or a quality count for nothing; without any label all
    documents are kept.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = good.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    target = rows_of(docs.select("doc_id", "text"), good.filter("quality = 1"))
    return resample(docs, target, share=1.0 if share is None else share)
