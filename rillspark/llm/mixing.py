"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations.

Slot i of the schedule goes to the source whose share of the unit interval holds the golden-ratio point frac(i * phi), so any
stretch of the schedule is close to the weights.  A slot's rank among its source's slots names the block of the source's
shuffled word stream that it reads; ranks beyond the last block start the next pass.  A source's blocks have equal numbers of
words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, read_table, spread_join

#: Words of a block, and the least blocks that a source is cut into, as far as it has that many words.
BLOCK_WORDS, LEAST_BLOCKS = 512, 256
#: The fraction of the golden ratio, and that of 2^20 times it: i * phi is summed from both, exactly enough for 2^40 slots.
PHI = 0.6180339887498949
PHI_HIGH = math.fmod((1 << 20) * PHI, 1.0)
SEED = 20

BEFORE = (Window.unboundedPreceding, -1)


def golden_point(slot: Column) -> Column:
    low = F.pmod(slot, F.lit(1 << 20))
    high = F.floor(slot / (1 << 20))
    return F.pmod(high * F.lit(PHI_HIGH) + low * F.lit(PHI), F.lit(1.0))


def targets(sources: DataFrame, share: float, limit: float) -> DataFrame:
    """``(source, size, weight)`` with ``target``: ``share`` of all sizes dealt by weight, at most ``limit`` times a size.

    What stops at its limit frees its rest for the others, by weight: the level at which the shares stop is found on the sources
    ordered by limit for each unit of weight.
    """
    everything = Window.partitionBy(F.lit(0))
    by_level = everything.orderBy("level", "source").rowsBetween(*BEFORE)
    w = (
        sources.withColumn("most", F.lit(limit) * F.col("size"))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("most").over(by_level), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
        .withColumn("fair", (F.col("total") - F.col("stopped")) / F.col("rest_weight"))
    )
    # The first source, in that order, that doesn't reach its limit sets the level for itself and all after it.
    level = F.min(F.when(F.col("fair") <= F.col("level"), F.struct("level", "source", "fair"))).over(everything)
    return w.withColumn("cut", level).select(
        "source",
        "size",
        "weight",
        F.when(F.col("cut").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("cut.fair") * F.col("weight"))).alias("target"),
    )


def weigh_sources(sized: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """``(source, size, weight)``: sources by code point, null last, take the weights of ``cycle`` in turn."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("size"))
        .withColumn("weight", F.element_at(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1))
    )


def block_plan(sources: DataFrame, block_words: int) -> DataFrame:
    """Each source's number, blocks, words a block, and its share [low, high) of the unit interval."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("size") / LEAST_BLOCKS)))
    planned = (
        sources.filter("size > 0 and target > 0")
        .withColumn("source_no", F.row_number().over(order))
        .withColumn("blocks", F.ceil(F.col("size") / words))
        .withColumn("block_words", F.col("size") / F.col("blocks"))
        .withColumn("slots", F.col("target") / F.col("block_words"))
        .withColumn("all_slots", F.sum("slots").over(everything))
    )
    return planned.withColumn("low", F.coalesce(F.sum("slots").over(order.rowsBetween(*BEFORE)), F.lit(0.0)) / F.col("all_slots")).withColumn(
        "high", F.when(F.row_number().over(order) == F.count(F.lit(1)).over(everything), F.lit(2.0)).otherwise(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("all_slots"))
    )


def schedule(plan: DataFrame, slots: int, sources: int, passes: int) -> DataFrame:
    """``(slot, source_no, rank, block)``: the slots in order, each with the source and block it reads."""
    spark = plan.sparkSession
    grid = max(1024, 4 * sources)
    cell = lambda x: F.floor(x * grid)
    cells = plan.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(grid - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x")).withColumn("cell", cell(F.col("x")))
    drawn = points.join(cells, "cell").filter("x >= low and x < high")
    # Ranks in two steps, each over about the square root of the slots: within a stretch, and of the stretches before it.
    stretch = max(1024, math.isqrt(slots))
    drawn = drawn.select("slot", "source_no", "blocks", F.floor(F.col("slot") / stretch).alias("stretch"))
    before = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(*BEFORE)
    earlier = (
        drawn.groupBy("source_no", "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    )
    within = Window.partitionBy("source_no", "stretch").orderBy("slot")
    return (
        drawn.withColumn("in_stretch", F.row_number().over(within) - 1)
        .join(earlier, ["source_no", "stretch"])
        .withColumn("rank", F.col("earlier") + F.col("in_stretch"))
        .filter(F.col("rank") < passes * F.col("blocks"))
        .select("slot", "source_no", "rank", F.pmod("rank", "blocks").alias("block"))
    )


def streams(numbered: DataFrame, rows: int) -> DataFrame:
    """``(source_no, doc_id, size, start, ...)``: every row's place in its source's shuffled word stream.

    In two steps like the ranks: within a cell, and of the cells before it, so that one source's rows are never one task's.
    """
    cells = max(64, math.isqrt(rows))
    mixed = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("size"))
    placed = numbered.withColumn("mixed", mixed).withColumn("cell", F.pmod("mixed", F.lit(cells)))
    # Equal rows can't be told apart: they are counted together and take neighbouring places.
    placed = placed.groupBy(*numbered.columns, "cell", "mixed").agg(F.count(F.lit(1)).alias("copies"))
    words = F.col("size") * F.col("copies")
    before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(*BEFORE)
    cell_starts = (
        placed.groupBy("source_no", "cell").agg(F.sum(words).alias("words")).withColumn("cell_start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    )
    within = Window.partitionBy("source_no", "cell").orderBy("mixed", "doc_id", "size").rowsBetween(*BEFORE)
    return (
        placed.withColumn("in_cell", F.coalesce(F.sum(words).over(within), F.lit(0)))
        .join(cell_starts, ["source_no", "cell"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
        .withColumn("start", F.col("cell_start") + F.col("in_cell") + F.col("copy") * F.col("size"))
        .drop("cell", "mixed", "copies", "in_cell", "cell_start", "copy")
    )


def pieces(placed: DataFrame) -> DataFrame:
    """The words ``[from_word, to_word)`` of each row in each block that it reaches into."""
    end, width = F.col("start") + F.col("size"), F.col("block_words")
    edge = lambda b: F.when(b >= F.col("blocks"), F.col("source_size")).otherwise(F.floor(b * width))
    first, last = F.greatest(F.lit(0), F.floor(F.col("start") / width) - 1), F.least(F.col("blocks") - 1, F.floor(end / width) + 1)
    return (
        placed.withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("from_word", F.greatest(F.col("start"), edge(F.col("block"))) - F.col("start"))
        .withColumn("to_word", F.least(end, edge(F.col("block") + 1)) - F.col("start"))
        .filter("to_word > from_word")
    )


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)`` of every row: words of the whole text, 0 if it is null."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sized, pieces, schedule)``: join the last two on ``source_no`` and ``block``, in order of ``slot``, for the mixture.

    A row without words has no piece.  A null source is a source of its own, the last one; null ids and repeated rows take
    places like any others.  No source is read more than ``passes`` times, so no row is.  An empty table gives empty ones.
    """
    sized = cut(sizes(docs), "mix-sizes")
    sources = cut(targets(weigh_sources(sized, cycle), share, float(passes)), "mix-sources")
    plan = cut(block_plan(sources, block_words), "mix-plan")
    totals = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0.0))).first()
    slots = cut(schedule(plan, round(totals[1]), totals[0], passes), "mix-schedule")
    of_source = plan.select(F.col("source").alias("of"), "source_no", "blocks", "block_words", F.col("size").alias("source_size"), "target")
    numbered = sized.filter("size > 0").join(of_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    everyone = sized.join(sources.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return everyone, pieces(streams(numbered, sized.count())), slots


def taken(docs: DataFrame) -> DataFrame:
    """The contract's columns: how many words the mixture takes of each row.

    A row that is null or has no words is there with 0; repeated rows, and rows that tie in id and size, take neighbouring places and
    are rows each.  Of a text, however long, only its number of words is kept.  An empty table gives an empty one, and other columns
    are left out, so their names can't clash.
    """
    everyone, parts, slots = mix(docs)
    uses = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
    words = (F.col("to_word") - F.col("from_word")) * F.coalesce(F.col("uses"), F.lit(0))
    row = ["doc_id", "source", "size", "source_size", "target", "start"]
    with_words = parts.join(uses, ["source_no", "block"], "left").groupBy(*row).agg(F.sum(words).alias("taken")).drop("start")
    without = everyone.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return with_words.unionByName(without)


def row_key(doc_id: Column, source: Column) -> Column:
    """A text for each id and source, nulls among them."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.concat(F.lit("of "), source), F.lit("")))


def repeat_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as the mixture takes them: each row as often as its words are taken, rounded; half-taken rows once.

    Rows of the same doc_id and source are repeated alike; rows without an id are such rows, and are spread where they are many.
    """
    times, key = free_name(docs, "_times"), free_name(docs, "_key")
    rounded = F.coalesce(F.floor(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0)) + 0.5), F.lit(0)).cast("int")
    of = taken(docs).groupBy(row_key(F.col("doc_id"), F.col("source")).alias(key)).agg(rounded.alias(times)).filter(F.col(times) > 0)
    keyed = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.col("source").cast("string")))
    found = spread_join(keyed, cut(of, "mix-times"), key, label="mix")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read_table(spark, sf_dir, "documents"))
