"""Phrases whose words stand together more often than their parts' counts let expect, for each language by itself.

A first pass counts phrases of one to three words in count-min sketches, one for each task, which are merged by adding them up.  A
sketch never counts too little, so a phrase that it puts below ``MIN_COUNT`` is out for certain; what is left, the survivors, are
counted exactly in a second pass.  So nothing frequent is lost, and the many rare phrases are never written out.

A sketch is never one large object: a task passes on the cells that it has counted in, in chunks of 2^16, a chunk's cells from all
tasks are added up as a stream, and one bit of each cell is left, whether it reached the minimum.  Those bits have a bound,
2 x ``MOST_CELLS`` / 8 bytes, and are broadcast.  The cells follow the size of the corpus up to that bound.  Beyond it more and more
phrases survive that aren't frequent, up to all of them; they cost work in the second pass, which counts whatever survives, and never
change a result.

Counts are exact to 10^15; the products behind a score are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, read_table, spread_join
from .simhash import mixed
from .spans import as_bytes, by_bytes, kinds, words_of

#: Phrases have this many words at most, and as candidates this many occurrences at least.
MOST_WORDS, MIN_COUNT = 3, 10
#: A candidate goes if a longer one that holds it has this share of its occurrences or more, in hundredths; so many stay of a language.
SUBSUMED, TOP = 50, 2000
#: Parts of a language's candidates that are ranked by themselves first.
PARTS = 64

TABLE = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")

#: Rows of cells of a sketch, and the fewest and most cells of one row.
DEPTH, LEAST_CELLS, MOST_CELLS = 2, 1 << 16, 1 << 27
#: Cells of a chunk, and phrases that a task gathers before it passes their cells on.
CHUNK, GATHERED = 1 << 16, 1 << 22


def splits(phrase: np.ndarray, piece: np.ndarray, size: int) -> np.ndarray:
    """The first words of all phrases of so many words within pieces."""
    n = len(piece) - size + 1
    return np.flatnonzero(piece[:n] == piece[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


class Batch:
    """The words of a batch of texts as numbers of a dictionary, and for each size the phrases' first words and hashes.

    A hash is of the language and the words: a collision makes a phrase survive and no more.
    """

    def __init__(self, batch: pa.RecordBatch, most_words: int):
        found = words_of(as_bytes(batch.column("text")), TABLE)
        coded = found.words.dictionary_encode()
        self.words, self.number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[found.text]
        hashed = lambda x: np.fromiter((xxhash.xxh64_intdigest(v.as_py()) for v in x), np.uint64, len(x))
        word = hashed(self.words)[self.number]
        so_far = mixed(hashed(self.langs), 1)[self.lang] if len(self.lang) else np.zeros(0, np.uint64)
        self.phrases: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, most_words + 1):
            first = splits(word, found.piece, size)
            n = len(found) - size + 1
            if n > 0:
                so_far = mixed(so_far[:n] ^ word[size - 1 :], size + 1)
            self.phrases.append((first, so_far[first] if n > 0 else np.zeros(0, np.uint64)))

    def __len__(self) -> int:
        return len(self.number)


def cells_of(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """The hashes' places in each row of cells, a power of two."""
    return [(hashes >> np.uint64(32 * row)) & np.uint64(cells - 1) for row in range(DEPTH)]


def counted_cells(docs: DataFrame, cells: int, most_words: int) -> DataFrame:
    """``(chunk, at, n)``: for each task, part by part, the cells that it counted in and how often, 255 at most."""

    def passed_on(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row, places in enumerate(cells_of(np.concatenate(hashes), cells)):
            at, n = np.unique(places, return_counts=True)
            at, n = at.astype(np.int64) + row * cells, np.minimum(n, 255).astype(np.uint8)
            starts = np.flatnonzero(np.diff(at // CHUNK, prepend=-1))
            ends = np.append(starts[1:], len(at))
            low = (at % CHUNK).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((at[starts] // CHUNK).astype(np.int32)),
                    pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ],
                ["chunk", "at", "n"],
            )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for part in by_bytes(rows, "text"):
            for _, hashes in Batch(part, most_words).phrases:
                gathered.append(hashes)
                size += len(hashes)
            if size >= GATHERED:
                yield from passed_on(gathered)
                gathered, size = [], 0
        if size:
            yield from passed_on(gathered)
        give_back()

    return docs.mapInArrow(batches, "chunk int, at binary, n binary")


def merged(counted: DataFrame, min_count: int) -> DataFrame:
    """``(chunk, bits)`` of chunks with any cell of ``min_count`` or more, a bit for each cell."""

    def reached(chunk: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = total >= min_count
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(CHUNK, np.int64)
        for batch in rows:
            for chunk, at, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if chunk != now:
                    if now is not None:
                        yield from reached(now, total)
                    now, total = chunk, np.zeros(CHUNK, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint8)
        if now is not None:
            yield from reached(now, total)

    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(batches, "chunk int, bits binary")


def sketch_cells(docs: DataFrame, min_count: int, most_words: int) -> int:
    """A power of two: a cell for each half of ``min_count`` phrases, of so many as the texts' bytes may have."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = 2 * most_words * (size // 6) // max(1, min_count)
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, int(wanted) - 1).bit_length()))


def survivors(docs: DataFrame, min_count: int, most_words: int) -> tuple[np.ndarray, int]:
    """The merged sketch's bits, row by row, and its cells."""
    cells = sketch_cells(docs, min_count, most_words)
    chunks = merged(counted_cells(docs, cells, most_words), min_count)
    bits = np.zeros(DEPTH * cells // 8, np.uint8)
    for r in chunks.toLocalIterator():  # 8 KB a chunk, 2 x MOST_CELLS bits together
        bits[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return bits, cells


def survive(bits: np.ndarray, cells: int, hashes: np.ndarray) -> np.ndarray:
    """Whether the sketch counted ``min_count`` or more: in each of its rows."""
    both = np.ones(len(hashes), bool)
    for row, places in enumerate(cells_of(hashes, cells)):
        places = places.astype(np.int64) + row * cells
        both &= (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
    return both


def exact_counts(docs: DataFrame, bits: np.ndarray, cells: int, min_count: int, most_words: int) -> DataFrame:
    """``(lang, size, phrase, n)`` of phrases with ``min_count`` occurrences or more; of size 0 all words of a language."""
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def rows_of(batch: Batch) -> Iterator[pa.RecordBatch]:
        lang, n = np.unique(batch.lang, return_counts=True)
        yield record(batch.langs.take(pa.array(lang)), 0, pa.nulls(len(lang), pa.binary()), n)
        for size, (first, hashes) in enumerate(batch.phrases, 1):
            first = first[survive(known.value, cells, hashes)]
            if not len(first):
                continue
            keys = np.stack([batch.lang[first], *(batch.number[first + i] for i in range(size))])
            order = np.lexsort(keys[::-1])
            keys = keys[:, order]
            starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            n, keys = np.diff(np.append(starts, len(order))), keys[:, starts]
            parts = [batch.words.take(pa.array(k)) for k in keys[1:]]
            phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
            yield record(batch.langs.take(pa.array(keys[0])), size, phrase, n)

    def record(lang: pa.Array, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        sizes = pa.array(np.full(len(n), size, np.int32))
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), sizes, phrase.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(rows, "text"):
            batch = Batch(part, most_words)
            if len(batch):
                yield from rows_of(batch)
        give_back()

    counted = docs.mapInArrow(batches, "lang string, size int, phrase string, n long")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | (F.col("size") == 0))


def words_at(phrase: Column, first: int, size: int) -> Column:
    """So many words of a phrase, space-joined, counted from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def scored(counts: DataFrame, most_words: int) -> DataFrame:
    """``(lang, size, phrase, a, l, r, n, score)`` of the candidates in ``counts``, each by its lowest-scoring cut."""
    key = F.struct("lang", "phrase").alias("part")
    of_part = counts.filter((F.col("size") > 0) & (F.col("size") < most_words)).select(key, F.col("n").alias("of"))
    cuts = reduce(
        DataFrame.unionByName,
        [
            counts.filter(F.col("size") == size).select(
                "lang", "size", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), words_at(F.col("phrase"), 1, k).alias("left"), words_at(F.col("phrase"), k + 1, size - k).alias("right")
            )
            for size in range(2, most_words + 1)
            for k in range(1, size)
        ],
    )
    # A part of a frequent phrase is as frequent, so every part is found; common words are parts of very many phrases.
    for side, name in (("left", "l"), ("right", "r")):
        rows = cuts.withColumn("part", F.struct("lang", F.col(side).alias("phrase")))
        cuts = cut(spread_join(rows, of_part.withColumnRenamed("of", name), "part", label="collocations-cuts").drop("part", side), f"collocations-{name}")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    totals = counts.filter("size = 0").select(F.col("lang").alias("_lang"), F.col("n").alias("n"))
    found = cuts.groupBy("lang", "size", "phrase", "a").agg(best).join(totals, F.col("lang") == F.col("_lang"))
    return found.select("lang", "size", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_subsumed(candidates: DataFrame, most_words: int, share: int) -> DataFrame:
    """The candidates that no longer one, kept or not, holds with ``share`` hundredths of their occurrences or more."""
    inner = [
        candidates.filter(F.col("size") == longer).select("lang", words_at(F.col("phrase"), at, size).alias("phrase"), F.col("a").alias("longer"))
        for longer in range(3, most_words + 1)
        for size in range(2, longer)
        for at in range(1, longer - size + 2)
    ]
    if not inner:
        return candidates
    held = reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    return candidates.join(held, ["lang", "phrase"], "left").filter(free).drop("longer")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, share: int = SUBSUMED, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: of each language the ``top`` phrases of two to ``most_words`` words.

    Words are runs of anything but spaces, tabs and the marks at which a phrase ends; A-Z count as lower case.  A null text has no
    words, a null language is ``und``, repeated rows count each time, texts of any length are read whole, and an empty table gives
    an empty one.  Other columns are left out, so their names can't clash.  Equal scores rank by occurrences, then by the phrase's
    bytes; ranks are unique.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    rows = rows.select(F.col("lang").cast("binary").alias("lang"), "text")
    bits, cells = survivors(rows, min_count, most_words)
    counts = cut(exact_counts(rows, bits, cells, min_count, most_words), "collocations-counts")
    candidates = cut(scored(counts, most_words), "collocations-scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # Of a language with most of the rows each of PARTS parts is ranked first, so no task has more than PARTS x top of its rows.
    kept = without_subsumed(candidates, most_words, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = kept.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", rank("lang")).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, n AS a FROM f WHERE k > 1 AND n >= {MIN_COUNT}),
cuts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS pl, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS pr FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < size),
s AS (
  SELECT cuts.lang, size, cuts.phrase, a, cuts.k, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = pl JOIN f y ON y.lang = cuts.lang AND y.phrase = pr
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(a) AS longer FROM c, (SELECT unnest([1, 2]) AS i) WHERE size = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SUBSUMED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
