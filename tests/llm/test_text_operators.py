"""Chat windows, collocations and ranked search against brute-force versions, and on odd rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rillspark.llm import chat_windows, collocations, common, language_id, mixing, ranked_search, ring_sharding, simhash, spans, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(frame):
    return Counter(tuple(r) for r in frame.collect())


# Words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aB é漢\t.\n\x0b-"), max_size=12), max_size=6))
def test_words_on_bytes(texts):
    found = spans.words_of([t if t is None else t.encode() for t in texts], collocations.TABLE)
    want = [(i, p, w) for i, t in enumerate(texts) for p, piece in enumerate(re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER))) for w in re.findall(r"[^\x20\x09]+", piece)]
    assert [w.as_py().decode() for w in found.words] == [w for _, _, w in want]
    assert found.text.tolist() == [i for i, _, _ in want]
    assert [a == b for a, b in zip(found.piece, found.piece[1:], strict=False)] == [a[:2] == b[:2] for a, b in zip(want, want[1:], strict=False)]


# 11

TURNS = "conv_id long, turn long, role string, text string"
one_a_character = lambda: len


def read_back(rows):
    """(role, text) of the turns that are new and the texts under the mask, of windows in order."""
    said, loss = [], []
    for r in sorted(rows, key=lambda r: (r.block is None, r.block, r.part, r.window)):
        turns = list(chat_windows.turns_of(r.text))
        assert len(turns) == r.n_turns
        said += [t[:2] for t in turns[r.n_repeated :]]
        loss += [chat_windows.unescaped(r.text[s.start : s.end]) for s in r.loss]
    return said, loss


def in_order(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in by_conv.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<\\/turn a>\n%0A25"), max_size=30), st.text(st.sampled_from("%0A25\n> <turn"), max_size=12))
def test_marks_are_escaped_reversibly(text, role):
    written = chat_windows.opening(role) + chat_windows.escaped(text) + chat_windows.CLOSING
    assert [t[:2] for t in chat_windows.turns_of(written * 2)] == [(role, text)] * 2


def odd_turns():
    rng = np.random.default_rng(1)
    rows = [(c, t, ("user", "assistant")[t % 2], "x" * int(rng.integers(0, 90))) for c in range(20) for t in range(int(rng.integers(1, 12)))]
    rows += [(50, 0, "system", "be kind")] + [(50, t, ("assistant", "user")[t % 2], f"turn {t} </turn>\n<turn user>\n") for t in range(1, 40)]
    rows += [(51, 0, "user", "hello"), (51, 1, "system", "not the first"), (51, 2, "assistant", "y" * 4000), (51, 3, "user", None), (51, None, "assistant", "last")]
    rows += [(None, 0, None, None), (None, 0, None, None), (None, 1, "assistant", "Ünïcode 漢字 😀")]
    rows += [(52, 5, "assistant", "tie b"), (52, 5, "assistant", "tie a"), (52, 5, "assistant", "tie a")]
    rows += [(53, -9, "a\nb%0A>", "<\\turn x>"), (53, 1 << 40, "assistant", ""), (54, 0, "system", "s" * 900), (54, 1, "assistant", "z" * 100)]
    return rows


@pytest.mark.parametrize("block_turns", [4096, 4])
@pytest.mark.parametrize(("budget", "history"), [(300, 100), (60, 20), (10_000, 0)])
def test_windows_read_back(spark, monkeypatch, budget, history, block_turns):
    monkeypatch.setattr(chat_windows, "BLOCK_TURNS", block_turns)
    monkeypatch.setattr(chat_windows, "BLOCK_BITS", block_turns.bit_length() - 1)
    rows = odd_turns()
    frame = spark.createDataFrame(rows, TURNS).select("*", *[F.lit(1).alias(c) for c in ("block", "lead", "window", "part", "head", "_conv")])
    found = chat_windows.windows(frame, one_a_character, budget, history).collect()
    by_conv = defaultdict(list)
    for r in found:
        by_conv[r.conv_id].append(r)
    want = in_order(rows)
    assert set(by_conv) == set(want)
    for conv, turns in want.items():
        said, loss = read_back(by_conv[conv])
        assert said == turns
        assert loss == [t for role, t in turns if role == "assistant"]
    for r in found:
        turns = list(chat_windows.turns_of(r.text))
        assert r.n_tokens == len(r.text)
        new = r.n_turns - r.n_repeated
        assert r.n_tokens <= budget or new == 1
        if want[r.conv_id][0][0] == "system":
            assert turns[0][:2] == want[r.conv_id][0]
        if r.window or r.part or (r.block and turns[0][0] == "system"):
            lead = len(r.text[: turns[0][3]]) + len(chat_windows.CLOSING) if want[r.conv_id][0][0] == "system" else 0
            repeated = r.text[: turns[r.n_repeated][2] - len(chat_windows.opening(turns[r.n_repeated][0]))]
            assert len(repeated) - lead <= history


def test_windows_repeat_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2], f"turn {t:02}") for t in range(1, 30)]
    found = sorted(chat_windows.windows(spark.createDataFrame(rows, TURNS), one_a_character, 300, 100).collect(), key=lambda r: r.window)
    shown = [[t[1] for t in chat_windows.turns_of(r.text)] for r in found]
    assert len(shown) > 3 and found[0].n_repeated == 0
    for before, now, r in zip(shown, shown[1:], found[1:], strict=False):
        assert now[0] == "be kind"
        repeated = now[1 : r.n_repeated]
        assert 1 <= len(repeated) <= 3 and before[-len(repeated) :] == repeated


def test_digests_of_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_windows.digests(chat_windows.windows(none, one_a_character)).count() == 0


def test_chat_windows_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in in_order([*rows, *chat_windows.CONTROL]).items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_windows.op11_chat_windows(spark, sf_dir).collect()}
    assert got == want


# 12


def brute_collocations(rows, min_count, most_words, share, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most_words + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = Counter()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows_of = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            held = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not held:
                rows_of.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out[lang, rank, phrase.decode(), -a, left, right, total[lang], -score] = 1
    return out


def some_texts():
    rng = np.random.default_rng(2)
    vocabulary = ["a", "b", "The", "the", "of", "new", "york", "city", "é", "漢", "x-y", "in\x0bto", "=", "\xa0"]
    text = lambda n: "".join(vocabulary[min(int(rng.geometric(0.2)), 14) - 1] + (" ", " ", "  ", "\t", ". ", "\n")[int(rng.integers(6))] for _ in range(n))
    rows = [(("en", "de", None, "und", "")[i % 5], text(int(rng.integers(0, 60)))) for i in range(300)]
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " . "), ("en", "New York City. " * 500), ("en", "new york city " * 400), *[("de", "same row twice")] * 7]


@pytest.mark.parametrize(("min_count", "most_words", "share", "top"), [(10, 3, 50, 2000), (3, 4, 80, 40), (1, 2, 50, 9)])
def test_collocations(spark, min_count, most_words, share, top):
    rows = some_texts()
    frame = spark.createDataFrame(rows, "lang string, text string").select("*", *[F.lit(1).alias(c) for c in ("n", "size", "phrase", "part", "a", "chunk", "rank")])
    got = counted(collocations.collocations(frame, min_count, most_words, share, top))
    assert got == brute_collocations(rows, min_count, most_words, share, top)


def test_a_small_sketch_loses_nothing(spark, monkeypatch):
    """With 64 Ki cells or few, in chunks of 1 Ki and tasks that pass on early, more survives and the result is the same."""
    rows = some_texts()
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute_collocations(rows, 10, 3, 50, 2000)
    monkeypatch.setattr(collocations, "CHUNK", 64)
    monkeypatch.setattr(collocations, "GATHERED", 100)
    for cells in (64, 1024):
        monkeypatch.setattr(collocations, "LEAST_CELLS", cells)
        monkeypatch.setattr(collocations, "MOST_CELLS", cells)
        assert counted(collocations.collocations(frame)) == want


def test_a_sketch_never_counts_too_little(spark):
    rows = some_texts()
    frame = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits, cells = collocations.survivors(frame, 10, 3)
    assert cells == collocations.LEAST_CELLS
    share = np.unpackbits(bits).mean()
    assert 0 < share < 0.05  # and it leaves the rare ones out
    assert len(bits) == collocations.DEPTH * cells // 8


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


# 13


def brute_search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(c.total() for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = Counter()
    for item, wanted in asked.items():
        found = []
        for i, c in tfs:
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1):
            out[item, rank, i, -score] += 1
    return out


def search_rows():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{min(int(rng.geometric(0.03)), 200)}" for _ in range(n))
    docs = [(i, text(int(rng.integers(1, 80)))) for i in range(400)] + [(i, "w1 w2-W3 same") for i in range(900, 880, -1)]
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w3 w4 w150"), (None, None), (700, ""), (701, "--- !!"), (702, "Straße ÉCOLE école 漢字 w1"), (703, text(30_000))]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(25)] + [(30, "same"), (31, "SAME w2"), (32, "no such"), (33, None), (34, "École STRASSE"), (None, "w3 w3"), (35, "w9"), (35, "w9 w10")]
    return docs, items


@pytest.mark.parametrize(("top", "block", "part_bytes"), [(50, 256, 32 << 20), (5, 8, 400), (3, 1, 1)])
def test_ranked_search(spark, monkeypatch, top, block, part_bytes):
    monkeypatch.setattr(ranked_search, "GROUP", 7)
    docs, items = search_rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("n", "terms", "score", "item_id", "rank", "tfs")]).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("w1"))
    if part_bytes == 1:
        asked, items = asked.filter("item_id < 4"), [i for i in items if i[0] is not None and i[0] < 4]
    assert counted(ranked_search.search(frame, asked, top, block, part_bytes)) == brute_search(docs, items, top)


def test_blocks_are_pruned(spark, monkeypatch):
    """One document has all of an item's terms, the others one common term: once its block is scored, no other has to be."""
    docs = [(i, "common " + " ".join(f"u{i}x{k}" for k in range(9))) for i in range(512)] + [(1000, "rare terms stand here and common too")] * 3
    items = [(1, "rare terms stand here")]
    index = ranked_search.forward_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), ranked_search.Asked.of([(1, t.encode()) for t in items[0][1].split()] + [(1, b"common")]).vocabulary)
    asked = ranked_search.Asked.of([(1, t.encode()) for t in items[0][1].split()] + [(1, b"common")])
    asked.weights = np.array([5000] * len(asked.vocabulary))
    blocks = ranked_search.blocks_of(index, 515, 5150, 16).coalesce(1)
    [batch] = blocks.toArrow().combine_chunks().to_batches()
    found = ranked_search.blocks_in(batch, asked)
    scored = [b for b in found if b.bounds[0] >= max(b.scores(asked.wanted(0)).max() for b in found)]
    assert len(found) > 30 and len(scored) == 1
    for b in found:
        assert (b.scores(asked.wanted(0)) <= b.bounds[0]).all()


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, i in ((docs, items), (docs, asked), (some, items), (some, asked.withColumn("text", F.lit(None).cast("string")))):
        assert ranked_search.search(d, i).count() == 0


# 2, the pipeline's stage


def random_fingerprints(n):
    return np.random.default_rng(n).integers(0, 1 << 63, (n, 4)).astype(np.uint64)


def test_pairs_compared_grow_with_the_rows():
    compared = []
    for n in (20_000, 80_000, 320_000):
        groups = [np.unique(k, return_counts=True)[1].astype(float) for k in simhash.dealt_keys(random_fingerprints(n), simhash.similar(n))]
        compared.append(sum((g * (g - 1) / 2).sum() for g in groups) / n)
    assert all(b < 1.6 * a for a, b in zip(compared, compared[1:], strict=False))
    # Key and fingerprint together are 40 bytes a table, compressed to less.
    assert [len(simhash.similar(n).dealt) for n in (1, 320_000, 10**9)] == [48, 110, 1187]


@pytest.mark.parametrize("rows", [1000, 320_000, 10**8])
def test_near_copies_of_real_texts_meet_in_a_key(spark, sf_dir, rows):
    """Real texts with words changed here and there, or a stretch taken out, until their shingle sets are just alike."""
    rng, scheme = np.random.default_rng(5), simhash.similar(rows)
    texts = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if len(r.text.split()) > 60]
    nodes = []
    for k, words in enumerate(texts * 2):
        changed, best = list(words), None
        for _ in range(len(words)):
            if k % 2:
                at = int(rng.integers(len(changed)))
                changed[at] = f"new{at}"
            else:
                del changed[len(changed) // 2]
            a, b = (simhash.shingle_set(" ".join(w).encode(), 5) for w in (words, changed))
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (len(a) + len(b) - both):
                break
            best = list(changed)
        if best:
            nodes.append([simhash.set_node(" ".join(w).encode(), 5, simhash.SIMILAR) for w in (words, best)])
    a, b = (np.stack([np.frombuffer(pair[i], "<u8") for pair in nodes]) for i in (0, 1))
    met = np.zeros(len(nodes), bool)
    for x, y in zip(simhash.dealt_keys(a, scheme), simhash.dealt_keys(b, scheme), strict=True):
        met |= x == y
    met &= np.bitwise_count(a[:, :3] ^ b[:, :3]).sum(axis=1) <= scheme.radius
    assert len(nodes) > 200 and met.mean() >= 0.9


def test_tables_by_turns_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    base[:, 3] = 100
    near = base.copy()
    near[:, 0] ^= np.uint64(0b10110)
    frame = spark.createDataFrame([(bytearray(x.tobytes()),) for x in np.concatenate([base, near])], "fp binary")
    edges = {tuple(sorted((bytes(r.u), bytes(r.v)))) for r in simhash.edges_of(frame, simhash.SIMILAR, "test").collect()}
    monkeypatch.setattr(simhash, "ROUND", 10)
    assert {tuple(sorted((bytes(r.u), bytes(r.v)))) for r in simhash.edges_of(frame, simhash.SIMILAR, "test").collect()} == edges
    assert len(edges) == 40


def test_few_keys_of_a_fingerprint_are_there_at_once(spark, monkeypatch):
    """However many tables it takes, their keys are shuffled by turns, and a turn's shuffle files go with it."""
    frame = common.cut(spark.createDataFrame([(bytearray(x.tobytes()),) for x in random_fingerprints(3000)], "fp binary"), "test")
    turns, after, key_rows, cut = [], [], simhash.key_rows, simhash.cut

    def noted(nodes, scheme):
        turns.append(len(scheme.dealt))
        return key_rows(nodes, scheme)

    def looked_at(df, label):
        before = shuffle_files(spark)
        out = cut(df, label)
        after.append(settled(lambda: not shuffle_files(spark) - before))
        return out

    monkeypatch.setattr(simhash, "key_rows", noted)
    monkeypatch.setattr(simhash, "cut", looked_at)
    tables = len(simhash.similar(400_000).dealt)
    simhash.edges_of(frame, simhash.similar(400_000), "test")
    assert sum(turns) == tables > 100 and max(turns) <= 32
    assert after and all(after)


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(x) for folder in manager.localDirs() for x in Path(folder.getPath()).rglob("shuffle_*.data")}


def settled(holds):
    for _ in range(100):
        if holds():
            return True
        time.sleep(0.1)
    return False


def test_a_cut_leaves_no_shuffle_files_and_the_setting_as_it_was(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for was in ("false", "true"):
        spark.conf.set(key, was)
        before = shuffle_files(spark)
        out = common.cut(spark.range(10_000).repartition(3, "id"), "test")
        assert settled(lambda: not shuffle_files(spark) - before)  # noqa: B023
        assert spark.conf.get(key) == was and out.count() == 10_000
        with pytest.raises(Exception, match="nowhere"):
            common.cut(spark.range(3).select(F.raise_error(F.lit("nowhere"))), "test")
        assert spark.conf.get(key) == was
    spark.conf.unset(key)


def test_large_components_are_judged_in_parts(spark, monkeypatch):
    """The smallest set of a component stands in several places, each with some of the others; odd rows and ties stay as they are."""
    rng = np.random.default_rng(23)
    texts = []
    for group in range(3):
        base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        texts += [" ".join(base[:k] + [f"new{group}x{k}"] + base[k + 1 :]) for k in range(10, 10 + 12)]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, None), (90, "")], "doc_id long, text string")
    whole = sorted(map(str, simhash.keep_one(docs).collect()))
    assert len(whole) == 4
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert sorted(map(str, simhash.keep_one(docs).collect())) == whole


# 10, 4, 3 at small limits


def test_archive_files_end_by_bytes_after_whole_records(spark, tmp_path):
    """Records of several members each, files of a few records: every file can be read by itself."""
    rng = np.random.default_rng(1)
    text = lambda n: bytes(rng.integers(33, 127, n, np.uint8)).decode()
    pages = [(i, f"u{i}", text(int(rng.integers(0, 4000)))) for i in range(40)] + [(100, "long", text(30_000)), (101, "again", text(10)), (102, "null", None)]
    pages += [(200 + i, "copy", pages[3][2]) for i in range(5)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("digest", "bytes", "copies", "value", "record_id", "first", "of")])
    path = f"file://{tmp_path}/archives"
    warc.write_archives(frame.coalesce(1), path, file_bytes=3000, member=400)
    files = sorted((tmp_path / "archives").glob("part-*"))
    assert len(files) > 20
    read = []
    for file in files:
        data = file.read_bytes()
        records = list(warc.parse(io.BytesIO(gzip.decompress(data))))
        read += records
        one = len(gzip.compress(b"".join(b for _, b in records[:-1])))
        assert one < 3000 + 4500
    assert len(read) == len(pages)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve(warc.read_archives(spark, path)).collect()}
    want = {i: ("response", None, len(t or "")) for i, _, t in pages}
    want.update({200 + i: ("revisit", 3, len(pages[3][2])) for i in range(5)})
    assert got == want


@pytest.mark.parametrize("rows", [1 << 20, 3])
def test_mixed_rows_without_ids_are_spread(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "SPREAD_ROWS", rows)
    docs = [(None, "a b c", "x", i) for i in range(20)] + [(None, "d e", None, i) for i in range(9)] + [(7, None, "x", 0), (8, "f g", "of y", 1), (9, "h", "", 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, _times int")
    got = counted(mixing.repeat_rows(frame))
    taken = defaultdict(lambda: [0, 0])
    for r in mixing.taken(frame).collect():
        taken[r.doc_id, r.source][0] += r.taken
        taken[r.doc_id, r.source][1] += r["size"]
    want = Counter()
    for d in docs:
        n, size = taken[d[0], d[2]]
        want[d] += math.floor(n / size + 0.5) if size else 0
    assert got == +want and set(got) <= set(docs)


def test_a_sample_is_bounded_by_bytes(spark):
    rows = [(i, "word " * 20, "a") for i in range(2000)] + [(10_000 + i, "x" * 5000, "b") for i in range(20)] + [(20_000 + i, "y", f"l{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = lambda sample: sum(len(r.text) for r in sample)
    sample = language_id.sample_of(frame, 500).collect()
    by = Counter(r.lang for r in sample)
    assert 400 < by["a"] < 600 and by["b"] == 20 and len(by) == 32
    small = language_id.sample_of(frame, 500, 64_000).collect()
    by = Counter(r.lang for r in small)
    assert len(by) == 32 and by["b"] == 1  # the first of the draw, though it alone is over its part
    assert size(small) < 64_000
    assert sorted(small) == sorted(language_id.sample_of(frame.repartition(5), 500, 64_000).collect())
    assert language_id.sample_of(frame.limit(0), 500).count() == 0


@pytest.mark.parametrize("keys", [10, 20_000])
def test_filters_have_bits_for_their_keys(spark, keys):
    bloom = common.Bloom(spark.range(keys), "id")
    assert bloom.bits == max(common.BLOOM_LEAST, 1 << (16 * keys).bit_length())
    found = spark.range(4 * keys).select("id", bloom.may_have("id").alias("may")).groupBy("may").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).collect()
    by = {r.may: (r.n, r.least) for r in found}
    assert keys <= by[True][0] < keys * 1.05 + 1 and by[False][1] >= keys


# 7 and the pipeline with odd columns and rows


def test_bounded_loads_keep_columns_of_any_name(spark):
    rows = [(i % 7 if i % 5 else None, 7, f"c{i}", i, 3) for i in range(200)]
    keys = spark.createDataFrame(rows, "key long, at int, cell string, arc long, copies int")
    got = ring_sharding.bounded_loads(keys, 5)
    assert got.columns == [*keys.columns, "shard", "slot", "owner"]
    found = got.collect()
    assert Counter(tuple(r)[:5] for r in found) == Counter(rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(40)) for v in by.values()) and len(by) == 5
    with pytest.raises(ValueError, match="slot"):
        ring_sharding.bounded_loads(keys.withColumnRenamed("at", "Slot"), 5)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    text = "the river and the lake with water of this and that was for the people in a town by the sea where it is number {} and that is it"
    other = "der fluss und die stadt mit dem wasser für das haus von der frau nicht auf einem berg im schnee ist nummer {} und das ist es"
    rows = [(i, (text, other)[i % 2].format(i % 9 * 1000 + 7) + f" word{i} other{i * 3} more{i * 7} than{i * 11}", ("en", "de")[i % 2], "s", 1) for i in range(30)]
    rows += [(None, text.format("none"), "en", None, 1), (None, text.format("none"), "en", None, 1), (40, None, "en", "s", 1), (41, "", None, None, None), (42, "12 34 !", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("_id", "_hash", "_times", "_key", "fp", "rank", "digest")])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in got)
    assert set(ids) <= {None, *range(30)} and max(ids.values()) <= 2 and len(ids) > 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == frame.columns


def test_the_pipeline_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
