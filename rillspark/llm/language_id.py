"""Language spans of mixed texts: script ranges narrow the candidates, per-word scores and a switching penalty the rest.

A word's score for a language is the log probability of its character n-grams, against the mean of all languages.  Only
languages whose training text uses the word's script are candidates.  The Viterbi path over a text's words, with a price for
every change of language, labels its spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, give_back, read_table

#: Training texts of a language on the average (all, if it has fewer); the model keeps every n-gram of them.
SAMPLE_TEXTS = 1000
#: Bytes of the training texts of all languages together, about; and languages up to which their limits are broadcast.
SAMPLE_BYTES, BROADCAST_LANGUAGES = 32 << 20, 10_000
#: Letters of the n-grams of a word with its ends marked.
GRAM = 3
#: The price of a change of language, the most that one word can say, and the price of a language without the word's script.
SWITCH, MOST, WRONG_SCRIPT = 12.0, 8.0, 30.0
#: A span is identified if its words speak for its language by this much on the average.
LEAST_MEAN = 1.0
#: A language uses a script if it has this share of its letters.
SCRIPT_SHARE = 0.01
#: A longer run of letters, as in scripts without spaces, is read as several words of so many letters.
WORD_LETTERS = 40
#: Scores that a worker remembers, and texts whose paths are found together: so many, or fewer with that many characters.
MEMO_SCORES, TEXTS, CHARS = 600_000, 2000, 2_000_000

# First and last code points of the scripts' main blocks.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)

WORDS, ASCII_WORDS = re.compile(rf"[^\W\d_]{{1,{WORD_LETTERS}}}"), re.compile(f"[a-z]{{1,{WORD_LETTERS}}}")


def words_of(text: str) -> list[str]:
    """The lower-cased text's runs of letters, those of over ``WORD_LETTERS`` in parts: every letter is in a word."""
    text = text.lower()
    if text.isascii():
        return ASCII_WORDS.findall(text)
    found = WORDS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    # Numbers other than decimal digits, such as a superscript two, are word characters but no letters.
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((name for name, low, high in SCRIPTS if low <= c <= high), "other")


def grams_of(word: str) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)]


@dataclass
class Model:
    """Languages in order, each n-gram's log probabilities for them less their mean, and the languages of each script."""

    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]
    memo: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "rows": []}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each lower-cased word: the sum over its n-grams, within bounds, against languages of other scripts."""
        unknown = len(self.scores) - 1  # a row of zeros
        number = self.grams.get
        flat: list[int] = []
        starts = []
        for word in words:
            starts.append(len(flat))
            flat += [number(g, unknown) for g in grams_of(word)]
        found = np.add.reduceat(self.scores[flat], starts, axis=0) if words else np.zeros((0, len(self.languages)), np.float32)
        found = np.clip(found, -MOST, MOST)
        scripts = ["latin" if w.isascii() else script_of(w) for w in words]
        for script in set(scripts) & self.scripts.keys():
            if not self.scripts[script].all():
                of_script = np.array([s == script for s in scripts])
                found[np.ix_(of_script, ~self.scripts[script])] = -WRONG_SCRIPT
        return found

    def numbered(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each text's words as rows of the table of scores; new words are scored together."""
        if len(self.memo) * max(1, len(self.languages)) > MEMO_SCORES:
            self.memo.clear()
            self.rows.clear()
        memo = self.memo
        fresh: dict[str, None] = {}
        for words in texts:
            for w in words:
                if w not in memo:
                    memo[w] = len(memo)
                    fresh[w] = None
        self.rows.append(self.word_scores(list(fresh)))
        return [np.fromiter(map(memo.__getitem__, words), np.int32, len(words)) for words in texts]

    def paths(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the language of each word and what the word says for it, all texts a word at a time."""
        k = len(self.languages)
        if not k:
            return [(np.zeros(len(t), np.int16), np.zeros(len(t))) for t in texts]
        numbers = self.numbered(texts)
        table = self.rows[0] = np.concatenate(self.rows)
        del self.rows[1:]
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        words = np.concatenate([numbers[i] for i in order]) if len(order) else np.zeros(0, np.int32)
        switched = np.zeros((starts[-1], k), bool)
        from_best = np.zeros(starts[-1], np.int16)
        best = np.zeros((len(texts), k))
        going = int((sizes > 0).sum())
        longest = int(sizes[0]) if len(sizes) else 0
        for t in range(longest):
            while going and sizes[going - 1] <= t:
                going -= 1
            at, now = starts[:going] + t, best[:going]
            if t:
                top = now.argmax(axis=1)
                jump = now[np.arange(going), top] - SWITCH
                by_jump = jump[:, None] > now
                switched[at], from_best[at] = by_jump, top
                now = np.where(by_jump, jump[:, None], now)
            best[:going] = now + table[words[at]]
        labels = np.zeros(starts[-1], np.int16)
        state = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            while going < len(sizes) and sizes[going] > t:
                going += 1
            at = starts[:going] + t
            labels[at] = state[:going]
            state[:going] = np.where(switched[at, state[:going]], from_best[at], state[:going])
        said = table[words, labels] if len(words) else np.zeros(0, np.float32)
        out = [(labels[:0], said[:0])] * len(texts)
        for place, i in enumerate(order):
            own = slice(starts[place], starts[place + 1])
            out[i] = labels[own], said[own]
        return out


def sample_of(labelled: DataFrame, texts: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """``(text, lang)`` of about ``texts`` rows of each language, the same ones each time.

    All languages together have about ``size`` bytes, each the same part of these; of a language whose texts are longer fewer are
    drawn, but the first of the draw always is.
    """
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20))
    drawn = labelled.withColumn("draw", draw)
    of = drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("draw").alias("first"))
    of = cut(of, "language-counts")
    languages = of.count()
    share = F.least(F.lit(1.0), texts / F.col("n"), F.try_divide(F.lit(size / max(1, languages)), F.col("size")))
    limits = of.select("lang", "first", (share * (1 << 20)).alias("below"))
    # Rows of a language are many; where languages are few, as they should be, none of them is moved.
    limits = F.broadcast(limits) if languages <= BROADCAST_LANGUAGES else limits
    return drawn.join(limits, "lang").filter((F.col("draw") < F.col("below")) | (F.col("draw") == F.col("first"))).select("text", "lang")


def train(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on ``(doc_id, text, lang)`` rows without nulls.  ``sample_texts`` and ``SAMPLE_BYTES`` bound the sample and so the model.

    Repeated rows are in the sample together or not at all; without rows the model has no languages.
    """

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in rows:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for word, n in Counter(words_of(text.as_py())).items():
                    found[lang, "\x00" + script_of(word)] += n * len(word)
                    for g in grams_of(word):
                        found[lang, g] += n
            if len(found) > 500_000:
                yield flush(found)
        yield flush(found)

    def flush(found: Counter) -> pa.RecordBatch:
        rows = [(*k, n) for k, n in found.items()]
        found.clear()
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "gram", "n"])

    sample = sample_of(labelled, sample_texts)
    counts = cut(sample.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    grams = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n"))  # a row of a list for each language
    scripts = grams.filter(F.col("gram").startswith("\x00")).collect()  # scripts
    kept = grams.filter(~F.col("gram").startswith("\x00")).orderBy("gram").collect()  # the model
    return fit([(r.gram, {x.lang: x.n for x in r.by}) for r in kept], [(r.gram[1:], {x.lang: x.n for x in r.by}) for r in scripts])


def fit(grams: list[tuple[str, dict[str, int]]], scripts: list[tuple[str, dict[str, int]]]) -> Model:
    languages = sorted({lang for _, by in scripts for lang in by})
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.full((len(grams), len(languages)), 0.5)
    for i, (_, by) in enumerate(grams):
        for lang, n in by.items():
            counts[i, place[lang]] += n
    logs = np.log(counts / counts.sum(axis=0)) if grams and languages else counts
    letters = np.zeros(len(languages))
    for _, by in scripts:
        for lang, n in by.items():
            letters[place[lang]] += n
    # A script that no language uses leaves all as they are.
    uses = {s: np.array([by.get(x, 0) >= SCRIPT_SHARE * letters[place[x]] for x in languages]) for s, by in scripts}
    uses = {s: u for s, u in uses.items() if u.any()}
    scores = np.concatenate((logs - logs.mean(axis=1, keepdims=True), np.zeros((1, len(languages))))).astype(np.float32) if languages else np.zeros((1, 0), np.float32)
    return Model(languages, {g: i for i, (g, _) in enumerate(grams)}, scores, uses)


def groups(texts: pa.Array, most: int = TEXTS, chars: int = CHARS) -> Iterator[pa.Array]:
    """The texts in order, ``most`` or fewer at a time with no more than ``chars`` bytes, longer ones alone."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > start and (i - start == most or held + n > chars):
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += n
    yield texts.slice(start)


SPAN = pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])
VERDICT = "lang_pred string, score double, identified double, spans array<struct<first_word:int,words:int,lang:string>>"


def language_of(model: Model):
    """The column function of a text: a struct of lang_pred, score and spans.

    ``spans`` are ``(first_word, words, lang)`` over the text's words of letters; lang_pred is the language with the most
    letters, score its share of them; ``identified`` is the share of letters in spans whose words speak for the span's language.
    A text that is null or has no letter is ``und`` with score 0, as every text is for a model without languages.  Each task has the
    model, and the words that it remembers, for itself.
    """
    def verdict(words: list[str], path: np.ndarray, scores: np.ndarray) -> tuple[str, float, float, list[dict]]:
        if not words:
            return "und", 0.0, 0.0, []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.bincount(path, sizes, len(model.languages))
        top = int(letters.argmax())
        cuts = np.concatenate(([0], np.nonzero(path[1:] != path[:-1])[0] + 1, [len(path)]))
        sure = np.add.reduceat(scores, cuts[:-1]) >= LEAST_MEAN * np.diff(cuts)
        identified = float((np.add.reduceat(sizes, cuts[:-1]) * sure).sum() / sizes.sum())
        spans = [{"first_word": int(a), "words": int(b - a), "lang": model.languages[path[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
        return model.languages[top], float(letters[top] / letters.sum()), identified, spans

    @F.arrow_udf(f"struct<{VERDICT.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>")
    def of(text: pa.Array) -> pa.Array:
        out = []
        for part in groups(text):
            texts = [words_of(t) if t and model.languages else [] for t in part.to_pylist()]
            out += [verdict(words, *found) for words, found in zip(texts, model.paths(texts), strict=True)]
        texts = []
        give_back()
        langs, scores, identified, spans = zip(*out, strict=True) if out else ((), (), (), ())
        columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(identified, pa.float64()), pa.array(spans, pa.list_(SPAN))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "identified", "spans"])

    return of


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, identified, spans)`` of every row of ``docs``; other columns are left out.

    Null ids and repeated rows get a row each; of languages that tie the first by name is taken; an empty table gives an empty one.
    """
    verdict = language_of(model)(F.col(text_col).cast("string")).alias("verdict")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), verdict).select("doc_id", "verdict.*")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == 2


def train_on(docs: DataFrame) -> Model:
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return train(usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return label(docs, train_on(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the texts that are ``und`` or have less than ``least`` of their letters in identified spans.

    A text in several languages stays, whatever the share of each.  All columns stay as they are, so do repeated rows; an empty
    table, or one without labels to learn from, gives an empty one.
    """
    name = free_name(docs, "_verdict")
    marked = docs.withColumn(name, language_of(train_on(docs))(F.col("text").cast("string")))
    return marked.filter((F.col(name)["lang_pred"] != "und") & (F.col(name)["identified"] >= least)).drop(name)
