"""Consistent hashing with virtual nodes and bounded loads, in DataFrame operations.

Every shard owns virtual nodes on a ring of 2^32 positions; a key belongs to the arc that ends at the next node clockwise.
A shard takes at most its bound.  Rows beyond it, last in the order of their positions on the shard's arcs, continue
clockwise to the next shard with room (Mirrokni, Thorup and Zadimoghaddam, "Consistent hashing with bounded loads").

How many rows of an arc stay and where the rest goes depends only on the arcs' row counts: a table of shards x virtual nodes
rows, whatever the input's size.  The walk around the ring is planned on it; the rows then look up their place by arc and by
rank in the arc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

RING = 1 << 32
#: Virtual nodes of a shard, and cells of the grid by which a position finds its arc; the ring's table is bounded by both.
VIRTUAL_NODES, GRID = 256, 1 << 14
#: Cells of an arc, so that ranks are counted in more tasks than arcs.
CELLS = 64


def position(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(RING))


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``(arc, shard, low, high)``: arcs in clockwise order; the last node's arc goes on at 0, so arc 0 has two rows."""
    nodes = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), position(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at")
    )
    # One owner for each position; the table is no longer than shards x virtual_nodes.
    nodes = nodes.groupBy("at").agg(F.min("shard").alias("shard"))
    clockwise = Window.partitionBy(F.lit(0)).orderBy("at")
    arcs = nodes.select(
        (F.row_number().over(clockwise) - 1).cast("int").alias("arc"),
        "shard",
        (F.lag("at", 1, -1).over(clockwise) + 1).alias("low"),
        F.col("at").alias("high"),
        F.max("at").over(Window.partitionBy(F.lit(0))).alias("top"),
    )
    round_zero = arcs.filter("arc = 0").select("arc", "shard", (F.col("top") + 1).alias("low"), F.lit(RING - 1).alias("high"))
    return arcs.drop("top").unionByName(round_zero).filter("low <= high")


def with_arcs(keys: DataFrame, arcs: DataFrame) -> DataFrame:
    """Each row's arc by its ``at``: an equi-join on grid cells, since an arc covers a run of them."""
    width = RING // GRID
    cells = arcs.withColumn("grid", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    # At most shards x virtual nodes + grid + 1 rows of 40 bytes: below 1 MB for 16 shards, however long the input.
    hit = (F.floor(keys["at"] / width) == cells["grid"]) & (keys["at"] >= cells["low"]) & (keys["at"] <= cells["high"])
    return keys.join(F.broadcast(cells), hit).select(*[keys[c] for c in keys.columns], "arc", F.col("shard").alias("owner"))


def plan_walk(counts: list[tuple[int, int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(arc, shard, from_rank, to_rank, first_slot)`` from ``(arc, shard, rows)`` in clockwise order.

    First every shard takes what its own arcs hold, up to its bound; then what is left of each arc walks clockwise.
    """
    room, taken, left, out = list(bounds), [0] * len(bounds), [], []

    def take(arc: int, shard: int, rank: int, n: int) -> None:
        out.append((arc, shard, rank, rank + n, taken[shard]))
        room[shard] -= n
        taken[shard] += n

    for k, (arc, shard, rows) in enumerate(counts):
        n = min(rows, room[shard])
        if n:
            take(arc, shard, 0, n)
        if rows > n:
            left.append((k, n, rows))
    for k, rank, rows in left:
        step = k
        while rank < rows:
            step += 1
            if step > k + len(counts):
                raise ValueError("the bounds hold fewer rows than there are")
            shard = counts[step % len(counts)][1]
            if n := min(rows - rank, room[shard]):
                take(counts[k][0], shard, rank, n)
                rank += n
    return out


def bounded_loads(keys: DataFrame, shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, label: str = "ring") -> DataFrame:
    """``keys`` ``(key, ...)`` with ``shard`` and ``slot``; slots number a shard's rows from 0 without gaps.

    A shard's bound is (1 + slack) times the mean; with slack 0 the bounds are the mean rounded down or, for as many shards
    as needed, up, so counts are at most one apart.  Rows that are equal in all columns are counted together and dealt out
    one by one, null keys too, so no key needs a task of its own.  An empty table gives an empty one.  Columns may have
    any names but ``shard``, ``slot`` and ``owner``, which the result adds.
    """
    if clash := {"shard", "slot", "owner"} & {c.lower() for c in keys.columns}:
        raise ValueError(f"the result adds columns of these names: {sorted(clash)}")
    spark, own = keys.sparkSession, keys.columns
    names = [f"k{i}" for i in range(len(own))]  # none of those that are used below
    keys = keys.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(own, names, strict=True)])
    grouped = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    grouped = grouped.withColumn("at", position(F.lit("key"), F.col(names[[c.lower() for c in own].index("key")])))
    arcs = cut(ring(spark, shards, virtual_nodes), f"{label}-arcs")
    grouped = with_arcs(grouped, arcs)
    grouped = cut(grouped.withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), *names), F.lit(CELLS)).cast("int")), f"{label}-keys")
    cells = grouped.groupBy("arc", "owner", "cell").agg(F.sum("copies").alias("rows"))
    # arcs x cells rows at most, and a window over the 64 of an arc
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    per_arc = cells.groupBy("arc").agg(F.sum("rows").alias("n"))
    clockwise = arcs.select("arc", "shard").distinct().join(per_arc, "arc", "left").orderBy("arc")
    counts = [(r.arc, r.shard, r.n or 0) for r in clockwise.collect()]  # shards x virtual nodes rows
    n = sum(c[2] for c in counts)
    if slack:
        bounds = [int((1 + slack) * n / shards) + 1] * shards
    else:
        bounds = [n // shards + (k < n % shards) for k in range(shards)]
    segments = spark.createDataFrame(plan_walk(counts, bounds), "arc int, shard int, from_rank long, to_rank long, first_slot long")
    within = Window.partitionBy("arc", "cell").orderBy("at", *names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        grouped.withColumn("start", F.coalesce(F.sum("copies").over(within), F.lit(0)))
        .join(cells.select("arc", "cell", "cell_start"), ["arc", "cell"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
        .withColumn("rank", F.col("cell_start") + F.col("start") + F.col("copy"))
    )
    # An arc has a segment for itself and one for each shard that its rest reaches: shards x (virtual nodes + shards) rows or so.
    place = (ranked["arc"] == segments["arc"]) & (ranked["rank"] >= segments["from_rank"]) & (ranked["rank"] < segments["to_rank"])
    return ranked.join(F.broadcast(segments), place).select(
        *[ranked[k].alias(c) for c, k in zip(own, names, strict=True)], segments["shard"], (segments["first_slot"] + ranked["rank"] - segments["from_rank"]).alias("slot"), ranked["owner"]
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's columns; a null text has size 1 and the CRC of no bytes, a null doc_id a place like any other key.

    Of a text, however long, only its size and its CRC are kept; repeated rows are rows each, an empty table gives an empty one, and
    other columns are left out, so their names can't clash.
    """
    keys = docs.select(
        F.col("doc_id").alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return bounded_loads(keys, shards).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "owner"
    )


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
