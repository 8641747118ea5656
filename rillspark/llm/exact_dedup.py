"""Exact deduplication against a history, through minimal perfect hashes over the history's distinct digests.

Digests are dealt to buckets by their own bits, which are uniform whatever the texts.  In each bucket a minimal perfect
hash (levels of bit arrays, Limasset et al., "Fast and scalable minimal perfect hashing for massive key sets") gives every
historical digest a slot of its own; the slot holds the full digest and the locator of the row that stays.  A lookup hashes
to one slot and compares all 32 bytes, so a stranger that lands on a taken slot is never mistaken for a member.
"""

from __future__ import annotations

import hashlib
import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen_rows, cut, free_name, give_back, outside, read_table, scratch, spread_join

#: Distinct digests meant for a bucket: a few MB in the task that builds or searches it.
BUCKET_DIGESTS = 30_000
#: Bits for each key of a level, and levels before the rest of a few keys is listed.
GAMMA, LEVELS = 2.0, 24

INDEX = "bucket int, slot long, digest binary, winner long, rows long, levels binary"


class PerfectHash:
    """Slots 0 to n-1 for n distinct digests.  ``levels`` are bit arrays; what collides on one goes to the next."""

    def __init__(self, levels: list[np.ndarray], rest: list[bytes]):
        self.levels, self.rest = levels, {d: i for i, d in enumerate(rest)}
        self.ranks = [np.concatenate(([0], np.cumsum(bits, dtype=np.int64))) for bits in levels]
        self.base = np.concatenate(([0], np.cumsum([r[-1] for r in self.ranks], dtype=np.int64)))

    @staticmethod
    def _spots(words: np.ndarray, level: int, size: int) -> np.ndarray:
        """words: digests as rows of four unsigned 64-bit words."""
        with np.errstate(over="ignore"):
            h = words[:, level % 4] * np.uint64(0x9E3779B97F4A7C15 + 2 * level) + words[:, (level + 1) % 4]
            h ^= h >> np.uint64(32)
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        words, levels = digests.view("<u8").reshape(-1, 4), []
        while len(words) and len(levels) < LEVELS:
            size = max(8, int(GAMMA * len(words)))
            spots = cls._spots(words, len(levels), size)
            alone = np.bincount(spots, minlength=size) == 1
            levels.append(alone)
            words = words[~alone[spots]]
        return cls(levels, sorted(w.tobytes() for w in words))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot that each digest would have as a member; -1 if it can't be one."""
        words = digests.view("<u8").reshape(-1, 4)
        out = np.full(len(words), -1, np.int64)
        todo = np.arange(len(words))
        for level, bits in enumerate(self.levels):
            spots = self._spots(words[todo], level, len(bits))
            hit = bits[spots]
            out[todo[hit]] = self.base[level] + self.ranks[level][spots[hit]]
            todo = todo[~hit]
        for i in todo:
            out[i] = self.rest.get(words[i].tobytes(), -1 - self.base[-1]) + self.base[-1]
        return out

    def dump(self) -> bytes:
        parts = [len(self.levels).to_bytes(4, "little")]
        for bits in self.levels:
            parts += [len(bits).to_bytes(8, "little"), np.packbits(bits).tobytes()]
        return b"".join([*parts, *self.rest])

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        at, levels = 4, []
        for _ in range(int.from_bytes(data[:4], "little")):
            size = int.from_bytes(data[at : at + 8], "little")
            packed = np.frombuffer(data, np.uint8, (size + 7) // 8, at + 8)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += 8 + len(packed)
        return cls(levels, [data[i : i + 32] for i in range(at, len(data), 32)])


def column(rows: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *rows[name].cast(kind).chunks])


def matrix(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)


@F.arrow_udf(T.BinaryType())
def digest_of(text: pa.Array) -> pa.Array:
    """SHA-256 of the whole text after lower-casing A-Z; null counts as empty."""
    give_back()  # what the worker's task before has left
    return pa.array([hashlib.sha256(t.as_py().lower()).digest() for t in text.cast(pa.binary()).fill_null(b"")], pa.binary())


def with_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` of every row; other columns are left out, so their names can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col).cast("string")).alias("digest"))


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def distinct(rows: DataFrame) -> DataFrame:
    """``(digest, winner, rows)`` from ``(digest, doc_id, rows)``; copies are counted before they are shuffled."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("rows").alias("rows"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Of ``distinct``'s rows: a row for each slot, and in each bucket a row with slot -1 and the perfect hash."""

    def build(rows: pa.Table) -> pa.Table:
        digests = column(rows, "digest", pa.binary())
        words = matrix(digests)
        mph = PerfectHash.build(words)
        slots = mph.slots(words)
        order = np.argsort(slots)
        after_head = lambda first, values: pa.concat_arrays([pa.array([first], values.type), values.take(pa.array(order))])
        return pa.table(
            {
                "bucket": pa.array(np.full(len(slots) + 1, rows["bucket"][0].as_py(), np.int32)),
                "slot": after_head(-1, pa.array(slots, pa.int64())),
                "digest": after_head(None, digests),
                "winner": after_head(None, column(rows, "winner", pa.int64())),
                "rows": after_head(0, column(rows, "rows", pa.int64())),
                "levels": pa.array([mph.dump(), *[None] * len(slots)], pa.binary()),
            }
        )

    return history.withColumn("bucket", bucket_of(F.col("digest"), buckets)).groupBy("bucket").applyInArrow(build, INDEX)


def lookup(index: DataFrame, fresh: DataFrame, buckets: int) -> DataFrame:
    """``fresh``'s rows ``(digest, winner, rows)`` with ``member`` and the slot's ``old_winner`` and ``old_rows``."""

    def search(slots: pa.Table, probes: pa.Table) -> pa.Table:
        digests = column(probes, "digest", pa.binary())
        member, old_winner, old_rows = np.zeros(len(digests), bool), pa.nulls(len(digests), pa.int64()), pa.array(np.zeros(len(digests), np.int64))
        if len(slots) and len(digests):
            slots = slots.take(pa.array(np.argsort(column(slots, "slot", pa.int64()).to_numpy())))
            mph = PerfectHash.load(slots["levels"][0].as_py())
            held, keys = matrix(column(slots, "digest", pa.binary()).slice(1)), matrix(digests)
            at = mph.slots(keys)
            member = (at >= 0) & (held[np.maximum(at, 0)] == keys).all(axis=1)
            taken = pa.array(at + 1, mask=~member)  # the head stands first
            old_winner = column(slots, "winner", pa.int64()).take(taken)
            old_rows = column(slots, "rows", pa.int64()).take(taken).fill_null(0)
        found = {"digest": digests, "winner": column(probes, "winner", pa.int64()), "rows": column(probes, "rows", pa.int64())}
        return pa.table(found | {"member": pa.array(member), "old_winner": old_winner, "old_rows": old_rows})

    probes = fresh.withColumn("bucket", bucket_of(F.col("digest"), buckets))
    return (
        index.groupBy("bucket")
        .cogroup(probes.groupBy("bucket"))
        .applyInArrow(search, "digest binary, winner long, rows long, member boolean, old_winner long, old_rows long")
    )


def exact_dedup(rows: DataFrame, is_history: Column, label: str = "exact") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)``, a row for each row of ``rows`` ``(doc_id, digest)``.

    ``is_history`` says of a row, by ``doc_id``, whether it belongs to the indexed history.  Equal digests form a group, whose
    largest doc_id stays; null ids are below all others, and among rows with the same id and digest exactly one stays.  An
    empty table gives an empty one.
    """
    rows = rows.withColumn("old", F.coalesce(is_history, F.lit(False)))
    # A row for each digest and id; what is grouped by digest from here on is combined first, what is joined on it is spread.
    rows = cut(rows.groupBy("digest", "doc_id", "old").agg(F.count(F.lit(1)).alias("rows")), f"{label}-rows")
    history, fresh = distinct(rows.filter("old")), distinct(rows.filter("not old"))
    buckets = max(1, math.ceil(rows.count() / BUCKET_DIGESTS))
    index = cut(build_index(history, buckets), f"{label}-index")
    found = cut(lookup(index, fresh, buckets), f"{label}-found")
    updates = found.filter("member").select(
        "digest", F.greatest("winner", "old_winner").alias("new_winner"), (F.col("rows") + F.col("old_rows")).alias("new_rows")
    )
    known = (
        index.filter("slot >= 0")
        .join(updates, "digest", "left")
        .select("digest", F.coalesce("new_winner", "winner").alias("keep_id"), F.coalesce("new_rows", "rows").alias("group_size"))
    )
    groups = known.unionByName(found.filter("not member").select("digest", F.col("winner").alias("keep_id"), F.col("rows").alias("group_size")))
    copies = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return (
        spread_join(rows, groups, "digest", label=label)
        .select("doc_id", "keep_id", "group_size", "digest", copies.alias("copy"))
        .select("doc_id", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")
    )


def midpoint(docs: DataFrame) -> Column:
    """The history of a table that grows by id: ids below the middle of their range."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if low is None else F.col("doc_id") < (low + high) // 2


def dedup_table(docs: DataFrame, label: str = "exact") -> DataFrame:
    return exact_dedup(with_digests(docs), midpoint(docs), label)


def keep_one(docs: DataFrame, label: str = "exact-stage") -> DataFrame:
    """``docs`` with the row that stays of each group, all columns as they are whatever their names, as ``exact_dedup`` has it.

    Of a text, however long, only its digest is shuffled unless two filters leave it open whether its row stays.  Texts that are null or empty are one group; of rows with the same id and digest one stays; an empty table gives an empty one.
    """
    id_, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    names = [F.col("doc_id").alias(id_), F.col("digest").alias(digest)]
    with scratch():
        groups = dedup_table(docs, label).select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))
        keys = groups.groupBy("doc_id", "digest").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("copies"))
        with outside():
            keys = cut(keys.select(*names, "stays", "copies"), f"{label}-keys")
    marked = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(digest, digest_of(F.col("text").cast("string")))
    return chosen_rows(marked, (id_, digest), keys.filter("stays"), keys.filter("not stays"), label).drop(id_, digest)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_table(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
