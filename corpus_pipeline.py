"""A training corpus from raw documents: STAGES in order, each on all rows that the one before kept.

What holds of every stage: an empty table gives an empty one, null ids and repeated rows are rows like any others until a stage
drops copies, columns beyond those of documents pass through whatever their names, and texts of any length are read whole.
Stages with Python workers bound the session's Arrow batches by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillspark.llm import byte_bpe, common, exact_dedup, language_id, mixing, simhash


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in languages that the labels teach; null, empty and letterless texts go, mixed ones stay.

    The model is learned from this table's own labels; without any, no row stays.
    """
    common.bounded_batches(spark)
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z lower-cased and null as empty: that of the largest doc_id, null ids last; ties stay once."""
    common.bounded_batches(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, null ids last; texts without words are one group."""
    common.bounded_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, twice at most; a null source is a source, texts without words go."""
    return mixing.repeat_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: its number of tokens and the digests of its ids and of what they decode to; null counts as empty."""
    common.bounded_batches(spark)
    return byte_bpe.round_trip(docs, tables=0.5)  # the other stages' idle workers have memory beside it


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Hashed fingerprints, a trained model and the tokenizer are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table ``documents``; each stage's are written to the shared folder for the next."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
