"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read_table

SPACE = r"[\x20\x09-\x0D]"
LATIN = "[A-Za-zÀ-ɏ]"
#: Words below which a text can be without stop words by chance: the share is null then.
STOP_WORD_TEXT = 25
#: Words of the windows whose repeats count.
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les un du une que pour est par qui dans avec sur pas au "
    "el y los se del las con por no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure has to lie in [low, high]; an open end is None.  A measure that is null (nothing to divide by) passes."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2, high=14),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_share", low=0.02),
    Rule("dup_line_share", high=0.4),
)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of ``window`` words that the text has twice or more.

    Windows are told apart by 64-bit hashes.  Most texts repeat none, which a distinct count tells.  Of the others the hashes are
    sorted with their places, so that equal ones are neighbours: a word counts if one of the ``window`` windows that hold it
    repeats, and, places being taken in order, each repeating window adds the words that the one before it didn't reach.
    """

    def places(hashes: Column) -> Column:
        def count(ordered: Column) -> Column:
            same = lambda x, i: F.coalesce(x["hash"] == F.get(ordered, i)["hash"], F.lit(False))
            twice = F.filter(ordered, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
            spots = F.sort_array(F.transform(twice, lambda x: x["at"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1_000_000).cast("long").alias("last"))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).cast("long").alias("n"), i.cast("long").alias("last"))
            return F.aggregate(spots, start, step, lambda acc: acc["n"])

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_once(F.sort_array(pairs), count))

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n <= window, F.lit(0).cast("long")).otherwise(_once(hashes, places))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of every row; a null text has no words, and its ratios are null.

    Nothing is compared between rows: repeated rows and null ids get a row each, an empty table gives an empty one.  The work for
    a text grows as n log n with its words.  The stop words are of languages in Latin script, so the share of a text that has more
    of other characters is null.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    counts = _once(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    line_counts = _once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = rows.select(
        "doc_id",
        counts.alias("c"),
        line_counts.alias("l"),
        (F.char_length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(LATIN)).cast("long").alias("n_latin"),
    ).select("doc_id", "c.*", "l.*", "word_chars", "n_symbols", "n_latin")
    per_word = lambda x: F.try_divide(F.col(x), F.col("n_words"))
    return counted.select(
        "*",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbols_per_word"),
        F.when((F.col("n_words") >= STOP_WORD_TEXT) & (2 * F.col("n_latin") >= F.col("word_chars")), per_word("n_stop_words")).alias("stop_word_share"),
        F.try_divide(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict &= F.coalesce(F.col(r.measure) >= r.low, F.lit(True))
        if r.high is not None:
            verdict &= F.coalesce(F.col(r.measure) <= r.high, F.lit(True))
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns, a row for each row of ``docs``; other columns are left out, so their names can't clash.

    A text that is null or empty has no words and fails the base rules; see ``measures`` for the other cases.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes(rules)).alias("kept")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, array_to_string(words[i:i + 4], chr(32)) AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(5)) AS k) GROUP BY r),
c AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop, len(regexp_extract_all(text, '{LATIN}')) AS n_latin
  FROM w LEFT JOIN p USING (r)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 10 AND word_chars BETWEEN 2 * n_words AND 14 * n_words
    AND 1.0 * n_symbols / n_words <= 0.1 AND (n_words < 25 OR 2 * n_latin < word_chars OR 1.0 * n_stop / n_words >= 0.02) AND coalesce(1.0 * n_dup_lines / n_lines <= 0.4, true) AS kept
FROM b
"""
