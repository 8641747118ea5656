"""Ranked lexical search by block-max pruning.

The forward index has, for each document, the terms that any item asks for and how often it holds them; documents without any are
only counted.  A block is a range of documents in the order in which they're stored: their terms with what each adds to a score (its
impact, which the item's weight multiplies), and for each term of the block the largest impact there.

An item's bound in a block is the sum of its weights times these maxima; no document in the block can score more.  A task takes
``GROUP`` blocks at a time, sorts them for each item by their bounds and scores them in this order until a bound drops below the threshold: the lowest
score of the best ``top`` so far, or what a first round has shown that the result needs.  In that round every task scores one block
for each item, the one of the highest bound; the best of the tasks' ``top``-th scores is a threshold that holds everywhere.  A bound
equal to the threshold is scored, for the sake of smaller ids, so pruning never changes a result.

Items are dealt to parts whose terms have a bound, ``PART_BYTES``; a part's terms, weights and thresholds are broadcast, and each part
is a search of its own over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, read_table
from .spans import as_bytes, by_bytes, kinds, words_of

#: Documents of a block, blocks that a task sorts by their bounds at a time, and results of an item.
BLOCK, GROUP, TOP = 256, 256, 50
#: Bytes of the terms of a part's items, each item's counted with 16 bytes more for each; an item that has more is a part alone.
PART_BYTES = 32 << 20
#: What lengths and weights are computed with, in whole numbers: a document's length as its share of the mean counts half.
LENGTH_SHARE, SCALE, SATURATION, WEIGHT = 50, 1_000_000_000, 20, 1000

#: Letters and digits of ASCII and everything beyond it are of terms.
TABLE = kinds(breaks=bytes(b for b in range(128) if not chr(b).isalnum()))

INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"
BLOCKS = "doc_ids array<long>, sizes array<int>, terms array<int>, impacts array<int>, most_terms array<int>, most array<int>"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, term)``, each once: rows of one id are one item, also those whose id is null."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(rows, "text"):
            found = words_of(as_bytes(part.column("text")), TABLE)
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(found.text)), found.words], ["item_id", "term"])

    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(batches, "item_id long, term binary").distinct()


@dataclass
class Asked:
    """Items as rows of a sparse matrix: item i asks for ``terms[starts[i]:starts[i + 1]]``, numbers in ``vocabulary``; weights beside."""

    items: list[int | None]
    starts: np.ndarray
    terms: np.ndarray
    vocabulary: pa.Array
    weights: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple[int | None, bytes]]) -> Asked:
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        coded = pa.array([bytes(t) for _, t in rows], pa.binary()).dictionary_encode()
        ids = [i for i, _ in rows]
        starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        return Asked([ids[i] for i in starts[:-1]], np.array(starts), coded.indices.to_numpy().astype(np.int64), coded.dictionary)

    def bounds(self, most: np.ndarray) -> np.ndarray:
        """What each item's terms add up to, of so much for each term of the vocabulary."""
        return np.add.reduceat((most * self.weights)[self.terms], self.starts[:-1])

    def wanted(self, item: int) -> np.ndarray:
        """The item's weight of each term of the vocabulary."""
        terms = self.terms[self.starts[item] : self.starts[item + 1]]
        out = np.zeros(len(self.vocabulary), np.int64)
        out[terms] = self.weights[terms]
        return out


def forward_index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of documents with any term: n of all kinds, and the numbers and counts of those in ``vocabulary``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(rows, "text"):
            found = words_of(as_bytes(part.column("text")), TABLE)
            n = np.bincount(found.text, minlength=part.num_rows)
            number = pc.index_in(found.words, value_set=known.value)
            there = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
            pairs = found.text[there] * len(known.value) + number.take(pa.array(there)).to_numpy().astype(np.int64)
            pairs, tfs = np.unique(pairs, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(known.value)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pairs % len(known.value), tfs)]
            filled = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(filled), pa.array(n[n > 0]), *[x.take(filled) for x in lists]], ["doc_id", "n", "terms", "tfs"])
        give_back()

    return docs.mapInArrow(batches, INDEX)


def blocks_of(index: DataFrame, n_docs: int, n_terms: int, size: int) -> DataFrame:
    """The forward index in blocks, with impacts in place of counts."""

    def block(rows: pa.RecordBatch) -> list:
        length = 100 - LENGTH_SHARE + LENGTH_SHARE * rows.column("n").to_numpy() * n_docs // n_terms
        sizes = rows.column("terms").value_lengths().to_numpy()
        terms, tfs = (rows.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        impacts = SCALE * tfs // (1000 * tfs + SATURATION * np.repeat(length, sizes))
        order = np.argsort(terms, kind="stable")
        starts = np.flatnonzero(np.diff(terms[order], prepend=-1))
        most = np.maximum.reduceat(impacts[order], starts) if len(starts) else impacts
        return [rows.column("doc_id").to_pylist(), sizes, terms, impacts, terms[order][starts], most]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, size):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block(whole.slice(at, size)), types, strict=True)], names)

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
    return index.filter(F.size("terms") > 0).mapInArrow(batches, BLOCKS)


@dataclass
class Block:
    ids: list[int | None]
    starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    bounds: np.ndarray

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        """Each document's score; every one has a term at least."""
        return np.add.reduceat(self.impacts * wanted[self.terms], self.starts)


def groups(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, GROUP):
            yield batch.slice(at, GROUP)


def blocks_in(batch: pa.RecordBatch, asked: Asked) -> list[Block]:
    out = []
    for i in range(batch.num_rows):
        sizes, terms, impacts, most_terms, highest = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("sizes", "terms", "impacts", "most_terms", "most"))
        most = np.zeros(len(asked.vocabulary), np.int64)
        most[most_terms] = highest
        out.append(Block(batch.column("doc_ids")[i].as_py(), np.concatenate(([0], np.cumsum(sizes)[:-1])), terms, impacts, asked.bounds(most)))
    return out


def thresholds(blocks: DataFrame, asked: Asked, top: int) -> dict[int, int]:
    """For items, by number, a score that their last result has at least: what one block a task has shown."""
    known = blocks.sparkSession.sparkContext.broadcast(asked)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value
        best: list[tuple[int, int]] = [(0, 0)] * len(asked.items)  # the bound of the block scored, and the top-th score there
        for batch in groups(rows):
            found = blocks_in(batch, asked)
            bounds = np.stack([b.bounds for b in found])
            for item, at in enumerate(bounds.argmax(axis=0)):
                bound = int(bounds[at, item])
                if bound > best[item][0] and len(found[at].ids) >= top:
                    scores = found[at].scores(asked.wanted(item))
                    best[item] = (bound, int(np.partition(scores, -top)[-top]))
        there = [i for i, (_, score) in enumerate(best) if score]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([best[i][1] for i in there], pa.int64())], ["item", "least"])

    shown = blocks.mapInArrow(batches, "item int, least long").groupBy("item").agg(F.max("least").alias("least"))
    return {r.item: r.least for r in shown.collect()}  # a row for each of a part's items


class Best:
    """An item's best documents so far, ``top`` and those that tie with the last."""

    def __init__(self, top: int, least: int):
        self.top, self.least = top, max(1, least)
        self.found: list[tuple[int, int | None]] = []

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at):
            self.found += [(int(scores[i]), ids[i]) for i in at.tolist()]
            if len(self.found) > self.top:
                self.found.sort(key=order)
                del self.found[self.top :]
                self.least = max(self.least, self.found[-1][0])


def order(found: tuple[int, int | None]) -> tuple:
    """Highest scores first, then ascending ids, null before all."""
    return -found[0], found[1] is not None, found[1] or 0


def best_documents(blocks: DataFrame, asked: Asked, least: dict[int, int], top: int) -> DataFrame:
    """``(item_id, doc_id, score)``: of each task and item the documents that may be among the ``top``, as many at most."""
    known = blocks.sparkSession.sparkContext.broadcast((asked, least))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = known.value
        best = [Best(top, least.get(i, 0)) for i in range(len(asked.items))]
        for batch in groups(rows):
            found = blocks_in(batch, asked)
            bounds = np.stack([b.bounds for b in found])
            falling = np.argsort(-bounds, axis=0, kind="stable")
            for item, mine in enumerate(best):
                if bounds[falling[0, item], item] < mine.least:
                    continue
                wanted = asked.wanted(item)
                for at in falling[:, item].tolist():
                    if bounds[at, item] < mine.least:
                        break
                    mine.add(found[at].scores(wanted), found[at].ids)
        rows_of = [(asked.items[i], doc, score) for i, mine in enumerate(best) for score, doc in mine.found]
        columns = zip(*rows_of, strict=True) if rows_of else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])
        give_back()

    return blocks.mapInArrow(batches, "item_id long, doc_id long, score long")


def search_part(docs: DataFrame, asked: Asked, top: int, block: int) -> DataFrame | None:
    """``best_documents`` of all rows ``(doc_id, text)``; None where no document has a term."""
    index = cut(forward_index(docs, asked.vocabulary), "search-index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(WEIGHT * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    asked.weights = np.zeros(len(asked.vocabulary), np.int64)
    for r in counted.select("term", weight.alias("w")).toLocalIterator():  # a row for each term of a part
        asked.weights[r.term] = r.w
    blocks = cut(blocks_of(index, n_docs, n_terms, block), "search-blocks")
    return cut(best_documents(blocks, asked, thresholds(blocks, asked, top), top), "search-best")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item the ``top`` documents with the highest scores above 0.

    Rows of ``items`` with one id are one item, whose terms count once each, and null is an id; an item without terms, or whose terms
    no document has, gives no row.  Repeated rows of ``docs`` are documents of their own; a null text has no terms, and a null id
    ranks before others of the same score.  Texts of any length are read whole, empty tables give an empty one, and other columns
    are left out, so their names can't clash.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    terms = cut(item_terms(items), "search-terms")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    parts = -(-size // part_bytes)
    found = []
    for part in range(parts):
        mine = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else terms
        rows = [tuple(r) for r in mine.toLocalIterator()]
        if rows and (best := search_part(texts, Asked.of(rows), top, block)) is not None:
            found.append(best)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # Spark keeps each task's first rows before they are dealt by item.
    places = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(places)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH lowered AS (
  SELECT row_number() OVER () AS d, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (SELECT d, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT d, sum(tf) AS n FROM tf GROUP BY d),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
m AS (SELECT d, 100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n::BIGINT * nn) // ll AS m FROM n, total),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), w AS (SELECT term, CAST(floor({WEIGHT} * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
s AS (
  SELECT item_id, doc_id, d, sum(w * (({SCALE} * tf) // (1000 * tf + {SATURATION} * m))) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
