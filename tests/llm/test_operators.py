"""The corpus operators against brute-force versions, and on nulls, empty and long texts, ties, empty tables and odd columns."""

from __future__ import annotations

import base64
import hashlib
import math
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillspark.llm import (
    byte_bpe,
    common,
    components,
    exact_dedup,
    importance,
    language_id,
    license_scan,
    mixing,
    quality_rules,
    ring_sharding,
    simhash,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EN = "the river and the lake with water of this and that was for the people in a town by the sea where it is"
DE = "der fluss und die stadt mit dem wasser für das haus von der frau nicht auf einem berg im schnee ist"
LONG = " ".join(f"word{i % 997} tail{i % 89}" for i in range(30_000))


def odd_rows():
    return [
        (1, EN, "en", "b", 1),
        (1, EN, "en", "b", 1),
        (2, EN.upper(), "en", "b", 1),
        (3, DE, "de", None, 1),
        (4, None, "de", "a", None),
        (5, "", None, "a", 0),
        (6, " \t\n ", "en", None, 3),
        (None, "Ünïcode ñ 漢字 😀 text", None, "a", 1),
        (None, None, None, None, None),
        (7, LONG, "en", "c", len(LONG)),
        (8, "MIT " * 50, "en", "c", 1),
        (9, "1234 5678 !!", "en", "c", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(odd):
    """Columns with the names that operators use inside."""
    names = "size fp digest key rank shard slot owner arc cell at copies start target block uses _key _times _verdict value score ids".split()
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(params=[1 << 20, 2])
def spread(request, monkeypatch):
    """Rows of a key beyond which joins spread it."""
    monkeypatch.setattr(common, "SPREAD_ROWS", request.param)


def words(text):
    return (text or "").encode().split()


# 1


def test_patience_alignment():
    a = "x the b c the d e".split()
    assert license_scan.align(a, "the b c the d".split()) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert license_scan.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert license_scan.align([], ["a"]) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_alignments_are_common_subsequences(a, b):
    pairs = license_scan.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_license_scan_finds_each_template_and_leaves_others(spark):
    rows = [(i, f"{EN} {t.upper() if i % 2 else t} {DE}") for i, t in enumerate(license_scan.TEMPLATES.values())]
    rows += [(100, EN), (101, f"the public general work of this version 3 {EN} is under the licensed GNU"), (102, None), (103, LONG + " Released under the MIT License.")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(license_scan.TEMPLATES):
        assert name in [m.license for m in got[i].matches]
        assert max(m.coverage for m in got[i].matches) == 1
    assert got[100].license is got[101].license is got[102].license is None
    assert got[103].license == "MIT"


def scanned(text, name):
    where = {}
    for i, w in enumerate(license_scan.words_of(text)):
        where.setdefault(w, []).append(i)
    return license_scan.Template(name, license_scan.TEMPLATES[name]).find(license_scan.words_of(text), where)


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
@pytest.mark.parametrize("between", ["", "and so on", EN])
def test_repeated_notices_are_found(name, between):
    notice = license_scan.TEMPLATES[name]
    for times in (2, 3):
        found = scanned(f"foreign words {between} {f' {between} '.join([notice] * times)} {between} more of them", name)
        assert found and found[0] == 1


@pytest.mark.parametrize(
    "text",
    [
        "Released under the BSD License.",
        "It was released under the new license.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        license_scan.TEMPLATES["GPL-3.0 (notice)"].replace("version 3", "version 2"),
        license_scan.TEMPLATES["Apache-2.0 (header)"].replace("2.0", "1.1"),
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Subject to the terms of the Mozilla Public License, v. 1.1. This Source Code Form is subject to the terms of it",
    ],
)
def test_other_licenses_and_prose_are_not_found(text):
    assert not [n for n in license_scan.TEMPLATES for t in (text, f"{EN} {text} {DE}") if scanned(t, n)]


def test_small_changes_of_short_notices_are_found():
    assert scanned(f"{EN} distributed under the MIT License {DE}", "MIT")
    assert scanned(f"{EN} licensed under the Apache License 2.0 {DE}", "Apache-2.0")


def test_whole_license_texts_are_told_apart(spark):
    names = [n for n in license_scan.TEMPLATES if n.endswith("(text)")]
    rows = [(i, f"Copyright 2020 someone. {license_scan.TEMPLATES[n]}") for i, n in enumerate(names)]
    rows += [(100 + i, t[: len(t) // 2] + " a few words of somebody else " + t[len(t) // 2 :]) for i, t in rows]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(names)), **{100 + i: n for i, n in enumerate(names)}}


def common_length(a, b):
    """The length of a longest common subsequence, by the table."""
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def test_op1_against_plain_search(spark, tmp_path):
    rng = np.random.default_rng(21)
    filler = [w for w in f"{EN} {DE} license version software public the under".split()]
    texts = []
    for name in license_scan.TEMPLATES:
        notice = license_scan.TEMPLATES[name].split()
        for drop in (0, 1, len(notice) // 3):
            kept = [w for i, w in enumerate(notice) if i not in set(rng.choice(len(notice), drop, replace=False))]
            texts.append(" ".join([*rng.choice(filler, 40), *kept, *rng.choice(filler, 40)]))
    texts += [" ".join(rng.choice(filler, 200)) for _ in range(10)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in license_scan.op1_license_scan(spark, str(tmp_path)).collect()}
    full = {r.doc_id: {m.license: m for m in r.matches} for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = license_scan.words_of(text or "")
        for name, template in license_scan.TEMPLATES.items():
            t = license_scan.words_of(template)
            whole = any(w[k : k + len(t)] == t for k in range(len(w) - len(t) + 1))
            assert not whole or full[i][name].coverage == 1
            if name in full[i]:  # no alignment covers more than the longest common subsequence of the place
                m = full[i][name]
                assert common_length(w[m.first_word : m.last_word + 1], t) >= round(m.coverage * len(t)) >= license_scan.LEAST_COVERAGE * len(t)
        assert got[i].licensed == bool(full[i]) and got[i].n_matches == len(full[i])
    assert not any(full[i] for i in range(len(texts) - 12, len(texts)))


def test_license_scan_on_odd_rows(odd, empty, clashing):
    got = license_scan.scan(clashing).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert not any(r.license for r in got)
    assert license_scan.scan(empty).count() == 0
    notice = odd.filter("doc_id = 1").select("doc_id", F.lit("Released under the MIT License.").alias("text"))
    assert [r.license for r in license_scan.scan(notice).collect()] == ["MIT", "MIT"]


# 2


def brute_fingerprint(text, width=3):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code():
    remainder, _ = simhash.golay_tables()
    every = np.arange(1 << 23, dtype=np.uint32)
    index = simhash.codeword_index(every)
    assert np.bitwise_count(every ^ (index << 11 | remainder[index])).max() == 3
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    b = a ^ (np.uint32(1) << rng.integers(0, 23, 300).astype(np.uint32)) ^ (np.uint32(1) << rng.integers(0, 23, 300).astype(np.uint32))
    for x, y in zip(simhash.ball_keys(a, 23)[0], simhash.ball_keys(b, 23)[0], strict=True):
        assert set(x) & set(y)


def brute_components(fps, radius):
    n = len(fps)
    label = list(range(n))
    while True:
        new = [min(label[j] for j in range(n) if sum(int(x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)) <= radius) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize(("scheme", "steps", "block"), [(simhash.NEAR, 3, 4096), (simhash.NEAR, 3, 3), (simhash.SIMILAR, 5, 4096)])
def test_every_link_within_the_radius_is_found(spark, scheme, steps, block):
    rng = np.random.default_rng(steps)
    fps = []
    for _ in range(25):
        fp = [int(x) for x in rng.integers(0, 1 << 63, len(scheme.seeds))]
        for _ in range(int(rng.integers(1, 9))):
            fps.append(tuple(fp))
            for bit in rng.choice(64 * len(fp), int(rng.integers(0, steps + 1)), replace=False):
                fp[bit // 64] ^= 1 << int(bit % 64)
    raw = [b"".join(x.to_bytes(8, "little") for x in fp) for fp in fps]
    got = {bytes(r.fp): bytes(r.root) for r in simhash.link(spark.createDataFrame([(bytearray(r),) for r in raw], "fp binary"), scheme, block=block).collect()}
    want = brute_components(fps, scheme.radius if scheme is simhash.NEAR else steps)
    for i in range(len(fps)):
        for j in range(i):
            if want[i] == want[j]:
                assert got[raw[i]] == got[raw[j]]
            elif scheme is simhash.NEAR:
                assert got[raw[i]] != got[raw[j]]


def test_hub_with_many_neighbours_in_small_blocks(spark):
    near = [0] + [1 << b for b in range(64)] + [1 << b | 1 << (b + 1) for b in range(60)]
    df = spark.createDataFrame([(bytearray(x.to_bytes(8, "little")),) for x in near], "fp binary")
    assert simhash.link(df, simhash.NEAR, block=8).select("root").distinct().count() == 1


def test_simhash_on_odd_rows(spark, odd, empty, clashing):
    for docs in (odd, clashing):
        rows = simhash.near_groups(docs).collect()
        assert len(rows) == docs.count()
        by_text = {r[0]: r[1] for r in odd_rows()}
        for r in rows:
            if r.doc_id is not None:
                assert int.from_bytes(bytes(r.fp), "little") == brute_fingerprint(by_text[r.doc_id])
        ids = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
        assert ids[1] == ids[2] == 1 and ids[4] == ids[5] == ids[6] == 4
    assert simhash.near_groups(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 7, 8, 9]


def test_op2_columns_are_the_brute_force_ones(spark, tmp_path, spread):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, int(rng.integers(0, 40)))) for _ in range(60)]
    texts += [f"{t} {t}" for t in texts[:5]] + texts[:5] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, str(tmp_path)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{fp:016x}" for fp in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components([(fp,) for fp in fps], 3)


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(vocabulary, 400)) for _ in range(12)]
    near = [t[:50] + ["changed"] + t[51:] for t in base[:6]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + near)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(12))


def test_stage_links_by_exact_similarity(spark):
    rng = np.random.default_rng(11)
    vocabulary, texts, want = [f"w{i}" for i in range(5000)], [], []
    for k in range(60):  # every fourth pair is over 0.8 by little, the others under it by little
        t = list(rng.choice(vocabulary, 304))
        changed, n = list(t), 6 if k % 4 == 0 else 10
        for at in range(20, 20 + 25 * n, 25):
            changed[at] = f"new{k}"
        a, b = (simhash.shingle_set(" ".join(x).encode(), 5) for x in (t, changed))
        near = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        assert near == (k % 4 == 0)
        want += [2 * k] if near else [2 * k, 2 * k + 1]
        texts += [" ".join(t), " ".join(changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


@pytest.mark.parametrize("sets", [4, 512])
def test_blocks_find_all_that_is_alike(spark, sets):
    rng = np.random.default_rng(17)
    rows, of = [], {}
    for group in range(3):
        base = rng.integers(0, 1 << 62, 60)
        for k in range(25):
            own = base[: int(rng.integers(35, 61))].copy()
            changed = rng.choice(len(own), int(rng.integers(0, 9)), replace=False)
            own[changed] = rng.integers(0, 1 << 62, len(changed))
            own = np.unique(own.astype(np.uint64))
            fp = bytes(16) + (int(rng.integers(1, 1 << 40)) << 24 | len(own)).to_bytes(8, "little")
            of[fp] = (group, own)
            rows.append((bytearray(str(group).encode()), bytearray(fp), False, bytearray(own.tobytes())))
    members = spark.createDataFrame(rows, "group binary, fp binary, linked boolean, of binary")
    pairs = [(a, b) for a in of for b in of if a < b and of[a][0] == of[b][0]]
    linked = [(a, b) for a, b in pairs if simhash.alike(of[a][1].tobytes(), of[b][1].tobytes())]
    assert 0 < len(linked) < len(pairs)

    def classes(edges):
        label = {fp: fp for fp in of}
        find = lambda x: x if label[x] == x else find(label[x])
        for a, b in edges:
            label[find(a)] = find(b)
        return {frozenset(x for x in of if find(x) == r) for r in of}

    assert classes((bytes(r.u), bytes(r.v)) for r in simhash.compared_in_blocks(members, sets).collect()) == classes(linked)


def test_stage_fingerprints_are_of_sets():
    rng = np.random.default_rng(13)
    line = " ".join(f"line{i}" for i in range(11))
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 100)) for _ in range(2)]
    a, b = (simhash.words_of(pa.array([simhash.set_node(f"{t} {(line + ' ') * 50}".encode(), 5, simhash.SIMILAR)]))[0] for t in texts)
    assert np.bitwise_count(a[:2] ^ b[:2]).sum() > simhash.SIMILAR.radius
    twice, often = (simhash.set_node(f"{texts[0]} {(line + ' ') * n}".encode(), 5, simhash.SIMILAR) for n in (2, 50))
    assert twice == often


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 3


def test_language_id_on_mixed_and_odd_texts(spark, odd, empty, clashing):
    train = [(i, (EN, DE)[i % 2] + f" x{i}", ("en", "de")[i % 2]) for i in range(200)] + [(300 + i, "привет как дела река и город", "ru") for i in range(20)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    rows = [(1, f"{EN} {DE} {DE}"), (2, "привет река"), (3, None), (4, "12 3 ²"), (5, EN)]
    got = {r.doc_id: r for r in language_id.label(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and got[1].lang_pred == "de" and 0.5 < got[1].score < 0.8
    assert abs(got[1].spans[0].words - len(EN.split())) <= 1
    assert got[2].lang_pred == "ru" and got[2].score == 1
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred) == ("und", 0.0, "und")
    assert len(got[5].spans) == 1
    assert language_id.label(clashing, model).count() == odd.count()
    assert language_id.label(empty, language_id.train_on(empty)).count() == 0
    assert {r.lang_pred for r in language_id.label(odd, language_id.train_on(empty)).collect()} == {"und"}
    assert language_id.keep_identified(clashing).columns == clashing.columns
    assert not {4, 5, 6, 9} & {r.doc_id for r in language_id.keep_identified(clashing).collect()}


def test_word_scores_are_log_probabilities_against_the_mean(spark):
    rows = [(1, "aab ab", "x"), (2, "ba bb", "y"), (3, "aab", "y"), (4, "cc", "z")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: Counter() for lang in "xyz"}
    for _, text, lang in rows:
        for w in text.split():
            counts[lang].update(f"\x02{w}\x03"[i : i + 3] for i in range(len(w)))
    grams = sorted(set().union(*counts.values()))
    logs = {lang: {g: math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(grams))) for g in grams} for lang, c in counts.items()}
    for word in ("aab", "abba", "qq"):
        own = [g for g in (f"\x02{word}\x03"[i : i + 3] for i in range(len(word))) if g in grams]
        want = [sum(logs[lang][g] - sum(logs[k][g] for k in "xyz") / 3 for g in own) for lang in "xyz"]
        assert model.word_scores([word])[0].tolist() == pytest.approx([max(-language_id.MOST, min(language_id.MOST, v)) for v in want], abs=1e-4)
    # Two models of the same languages and n-grams in one session, whatever worker labels: each gives its own answer.
    other = language_id.train(spark.createDataFrame([(1, "aab ab", "y"), (2, "ba bb", "x"), (3, "aab", "x"), (4, "cc", "z")], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "ab ab ab ab")], "doc_id long, text string").coalesce(1)
    assert [language_id.label(docs, m).first().lang_pred for m in (model, other, model)] == ["x", "y", "x"]


def test_texts_of_several_languages_stay(spark):
    train = [(i, (EN, DE)[i % 2] + f" x{i}", ("en", "de")[i % 2]) for i in range(100)] + [(200 + i, "привет как дела река и город", "ru") for i in range(20)]
    mixed = [(900, f"{EN} {DE} " + "привет как дела река и город " * 4, None), (901, "ⴰⴱⴳ ⴷⴻⴼ ⴳⵀⵉ", None), (902, "12 34", None)]
    docs = spark.createDataFrame(train + mixed, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.keep_identified(docs).collect()}
    assert 900 in kept and not {901, 902} & kept and {t[0] for t in train} <= kept


def test_every_letter_of_a_long_run_is_read():
    for run in ("ab" * 75, "漢字" * 75):
        assert "".join(language_id.words_of(f"1{run}2")) == run
        assert max(map(len, language_id.words_of(run))) == language_id.WORD_LETTERS


def test_texts_are_taken_in_bounded_groups():
    texts = pa.array(["a" * n if n else None for n in (3, 0, 50, 4, 4, 4, 1, 1, 1)])
    parts = [p.to_pylist() for p in language_id.groups(texts, 3, 10)]
    assert sum(parts, []) == texts.to_pylist()
    assert [len(p) for p in parts] == [2, 1, 2, 3, 1]
    assert [p.to_pylist() for p in language_id.groups(texts.slice(0, 0))] == [[]]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b", "c"], {}, np.zeros((1, 3), np.float32), {})
    scores = rng.normal(0, 6, (9, 3)).astype(np.float32)
    model.word_scores = lambda new: scores[: len(new)]
    path = model.paths([[f"w{i}" for i in range(9)], [], ["w0", "w4"]])
    from itertools import product

    def value(p, at):
        return sum(scores[w][k] for w, k in zip(at, p, strict=True)) - language_id.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))

    for found, at in ((path[0][0], range(9)), (path[2][0], (0, 4))):
        assert value(found, at) == pytest.approx(max(value(p, at) for p in product(range(3), repeat=len(at))), abs=1e-4)


# 4


def brute_targets(sizes, cycle=(3, 1, 2), share=1.5):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: cycle[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing_comes_near_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 400, 900), rng.choice(["a", "b", "z", "é", ""], 900, p=[0.5, 0.2, 0.1, 0.1, 0.1]), strict=True))]
    rows += [(1000 + i, "x y", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes = Counter()
    for _, text, s in rows:
        sizes[s] += len(text.split())
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.04, abs=4)
    assert sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def brute_taken(rows):
    """Words taken of each row ``(doc_id, size, source, mixed)`` by walking the schedule slot by slot and the streams word by word."""
    sizes = Counter()
    for _, n, s, _ in rows:
        sizes[s] += n
    want, passes = brute_targets(sizes), 2
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    order = [s for s in order if sizes[s] and want[s]]
    blocks, width = {}, {}
    for s in order:
        words_a_block = max(1, min(mixing.BLOCK_WORDS, sizes[s] // mixing.LEAST_BLOCKS))
        blocks[s] = -(-sizes[s] // words_a_block)
        width[s] = sizes[s] / blocks[s]
    slots = {s: want[s] / width[s] for s in order}
    ends, total = [], sum(slots.values())
    for s in order:
        ends.append(sum(slots[x] for x in order[: order.index(s) + 1]) / total)
    ends[-1] = 2.0
    rank, uses = Counter(), Counter()
    for i in range(round(total)):
        x = math.fmod(i // (1 << 20) * mixing.PHI_HIGH + i % (1 << 20) * mixing.PHI, 1.0)
        s = next(s for s, end in zip(order, ends, strict=True) if x < end)
        if rank[s] < passes * blocks[s]:
            uses[s, rank[s] % blocks[s]] += 1
        rank[s] += 1
    cells, out = max(64, math.isqrt(len(rows))), Counter()
    for s in order:
        stream = sorted((r for r in rows if r[2] == s and r[1]), key=lambda r: (r[3] % cells, r[3], r[0], r[1]))
        edges = [math.floor(b * width[s]) for b in range(blocks[s])] + [sizes[s]]
        times = [uses[s, b] for b in range(blocks[s]) for _ in range(edges[b + 1] - edges[b])]
        at = 0
        for doc_id, n, _, _ in stream:
            out[doc_id] += sum(times[at : at + n])
            at += n
    return out


def test_op4_takes_what_the_schedule_says(spark, tmp_path):
    rng = np.random.default_rng(31)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 90, 300), rng.choice(["a", "b", "é"], 300, p=[0.6, 0.3, 0.1]), strict=True))]
    rows += [(500, None, None), (501, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    hashed = mixing.sizes(docs).select("doc_id", "size", "source", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"), F.col("size"))).collect()
    want = brute_taken([tuple(r) for r in hashed])
    assert {r.doc_id: r.taken for r in mixing.op4_mixing(spark, str(tmp_path)).collect()} == {r[0]: want[r[0]] for r in rows}


def test_the_schedule_keeps_to_the_weights_all_along(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    _, _, slots = mixing.mix(docs)
    rows = [r.source_no for r in slots.orderBy("slot").collect()]
    share = Counter(rows)
    for n in range(50, len(rows), 37):
        for s, k in share.items():
            assert abs(rows[:n].count(s) - n * k / len(rows)) < 5


def test_mixing_on_odd_rows(odd, empty, clashing):
    got = mixing.taken(clashing).collect()
    assert len(got) == odd.count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.taken(empty).count() == 0
    assert mixing.repeat_rows(clashing).columns == clashing.columns
    assert mixing.repeat_rows(empty).count() == 0
    times = Counter(r.doc_id for r in mixing.repeat_rows(clashing).collect())
    assert max(times.values()) <= 4 and times[5] == 0


# 5


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    mph = exact_dedup.PerfectHash.load(exact_dedup.PerfectHash.build(keys).dump())
    assert sorted(mph.slots(keys)) == list(range(5000))
    others = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(500)), np.uint8).reshape(-1, 32)
    assert ((mph.slots(others) >= -1) & (mph.slots(others) < 5000)).all()
    for n in (0, 1, 2):
        assert sorted(exact_dedup.PerfectHash.build(keys[:n]).slots(keys[:n])) == list(range(n))


@pytest.mark.parametrize("history", ["doc_id < 5", "false", "true"])
def test_exact_dedup(spark, odd, clashing, history, spread):
    got = exact_dedup.exact_dedup(exact_dedup.with_digests(clashing), F.expr(history)).collect()
    groups = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in odd_rows():
        groups.setdefault(hashlib.sha256((r[1] or "").translate(lower).encode()).digest(), []).append(r[0])
    assert len(got) == len(odd_rows())
    for r in got:
        ids = groups[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_index_and_lookup_keep_ids_exactly(spark):
    """Ids beyond doubles beside a null one; the workers of the stage do without pandas, whose memory they would keep."""
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    ids = [None, *[(1 << 53) + i for i in range(1, 40)]]
    kind = "digest binary, winner long, rows long"
    index = exact_dedup.build_index(spark.createDataFrame([(bytearray(digest(i)), w, i + 1) for i, w in enumerate(ids)], kind), 2)
    fresh = spark.createDataFrame([(bytearray(digest(i)), (1 << 53) + i if i % 2 else None, 1) for i in range(20, 60)], kind)
    found = exact_dedup.lookup(index, fresh, 2)
    for df in (index, found):
        assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert {bytes(r.digest): (r.winner, r.rows) for r in index.filter("slot >= 0").collect()} == {digest(i): (w, i + 1) for i, w in enumerate(ids)}
    got = {bytes(r.digest): (r.winner, r.rows, r.member, r.old_winner, r.old_rows) for r in found.collect()}
    assert got == {digest(i): ((1 << 53) + i if i % 2 else None, 1, i < 40, ids[i] if i < 40 else None, i + 1 if i < 40 else 0) for i in range(20, 60)}
    code = "import sys, corpus_pipeline; assert 'pandas' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=Path(exact_dedup.__file__).parents[2], check=True)


def test_exact_stage(odd, empty, clashing):
    kept = exact_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t in [(2, EN.upper()), (3, DE), (5, ""), (6, " \t\n "), (None, odd_rows()[7][1]), (7, LONG), (8, "MIT " * 50), (9, "1234 5678 !!")])
    assert exact_dedup.keep_one(empty).count() == 0
    assert exact_dedup.dedup_table(empty).count() == 0


# 6


def brute_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, clashing, empty):
    texts = [r[1] for r in odd_rows()] + ["a b c d e " * 4, "a b c d e f a b c d e", "x\n\ny\nx\n x\n#*$", "the " * 12, "a b c d e f g h i j k l a b c d e z c d e f g y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(docs).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}[0]
    assert quality_rules.judge(clashing).count() == clashing.count()
    assert quality_rules.judge(empty).count() == 0


def test_repeated_words_of_long_texts(spark):
    import time

    texts = [" ".join(f"w{i % (n // 2)}" for i in range(n)) for n in (20_000, 40_000)] + [LONG, "x " * 50_000]
    took = []
    for i, t in enumerate(texts):
        docs = spark.createDataFrame([(i, t)], "doc_id long, text string")
        at = time.monotonic()
        assert quality_rules.judge(docs).first().n_repeat_words == brute_quality(t)[4]
        took.append(time.monotonic() - at)
    assert max(took) < 20  # seconds, where a square takes minutes


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), min_size=8, max_size=8))
def test_repeated_words(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.judge(docs).collect():
        assert r.n_repeat_words == brute_quality(" ".join(texts[r.doc_id]))[4]


def test_rules_have_no_user_functions(odd):
    plan = quality_rules.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 7


def test_walk_goes_clockwise_and_fills_the_bounds():
    segments = ring_sharding.plan_walk([(0, 0, 5), (1, 1, 1), (2, 0, 0), (3, 2, 0)], [2, 2, 2])
    assert segments == [(0, 0, 0, 2, 0), (1, 1, 0, 1, 0), (0, 1, 2, 3, 1), (0, 2, 3, 5, 0)]
    with pytest.raises(ValueError, match="fewer rows"):
        ring_sharding.plan_walk([(0, 0, 5)], [2])


def shards(df):
    rows = df.collect()
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in out.values())
    return rows, {k: len(v) for k, v in out.items()}


def test_bounded_loads(spark):
    keys = spark.range(3000).select(F.col("id").alias("key"))
    rows, counts = shards(ring_sharding.bounded_loads(keys, 7))
    assert len(rows) == 3000 and max(counts.values()) - min(counts.values()) <= 1
    assert sum(r.shard != r.owner for r in rows) < 0.1 * len(rows)
    again, _ = shards(ring_sharding.bounded_loads(keys.repartition(5), 7))
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    loose, counts = shards(ring_sharding.bounded_loads(keys, 7, slack=0.25))
    assert max(counts.values()) <= 1.25 * 3000 / 7 + 1
    assert all(r.shard == r.owner for r in loose) or sum(r.shard != r.owner for r in loose) < 0.02 * len(loose)
    more, _ = shards(ring_sharding.bounded_loads(keys, 8, slack=0.25))
    before = {r.key: r.shard for r in loose}
    assert sum(before[r.key] != r.shard for r in more) < 2.5 * 3000 / 8


def test_op7_walks_row_by_row_as_the_ring_says(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(700)] + [(None, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, counts = shards(ring_sharding.op7_ring_sharding(spark, str(tmp_path)))
    assert len(rows) == 701 and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    arcs = sorted((r.arc, r.shard, r.low, r.high) for r in ring_sharding.ring(spark, 16).collect())
    at = [r[0] for r in docs.select(ring_sharding.position(F.lit("key"), F.col("doc_id"))).collect()]
    clockwise = sorted({(a, s) for a, s, _, _ in arcs})
    held = Counter(next(a for a, _, low, high in arcs if low <= x <= high) for x in at)
    room = [701 // 16 + (k < 701 % 16) for k in range(16)]
    placed, left = Counter(), []
    for k, (arc, owner) in enumerate(clockwise):
        for _ in range(held[arc]):
            if room[owner]:
                room[owner] -= 1
                placed[owner, owner] += 1
            else:
                left.append(k)
    for k in left:
        step = k
        while not room[clockwise[step % len(clockwise)][1]]:
            step += 1
        shard = clockwise[step % len(clockwise)][1]
        room[shard] -= 1
        placed[clockwise[k][1], shard] += 1
    assert Counter((r.owner, r.shard) for r in rows) == placed


def test_every_position_has_one_owner(spark):
    arcs = ring_sharding.ring(spark, 5, 16)
    rows = sorted((r.low, r.high) for r in arcs.collect())
    assert rows[0][0] == 0 and rows[-1][1] == ring_sharding.RING - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_sharding_odd_and_hot_rows(spark, odd, empty, clashing):
    rows, counts = shards(ring_sharding.shard_documents(clashing))
    assert len(rows) == odd.count() and max(counts.values()) == 1
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by_id[4]["size"], by_id[4].text_crc32, by_id[3].text_crc32) == (1, 0, zlib.crc32(DE.encode()))
    assert ring_sharding.shard_documents(empty).count() == 0
    hot = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows, counts = shards(ring_sharding.shard_documents(hot))
    assert len(rows) == 400 and set(counts.values()) == {25}


# 8


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.public_vocabulary()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return byte_bpe.Encoder(*vocabulary)


def test_ids_beyond_the_bits_are_refused():
    with pytest.raises(ValueError, match="token ids"):
        byte_bpe.Transducer({b"a": 1 << byte_bpe.ID_BITS})


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    import tiktoken

    data, pattern = vocabulary
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.parse_ranks(data), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(encoder, tokenizer, text):
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == tokenizer.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text("aeinrst é\x1c '\n1²", max_size=200))
def test_ids_of_words(encoder, tokenizer, text):
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == tokenizer.encode_ordinary(text)


def test_long_pieces_small_tables_and_resets(vocabulary, tokenizer, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 50)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 20)
    monkeypatch.setattr(byte_bpe, "WHOLE_TEXT", 100)
    encoder = byte_bpe.Encoder(*vocabulary)
    for text in ("abracadabra" * 700, "the end " * 90, "!?" * 4000, "漢字かな" * 300):
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == tokenizer.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30), st.integers(1, 4))
def test_streaming_decoder(text, size):
    data, stream = text.encode(), byte_bpe.Utf8Stream()
    assert "".join([*(stream.feed(data[i : i + size]) for i in range(0, len(data), size)), stream.close()]) == text


def test_bpe_on_odd_rows(tokenizer, odd, empty, clashing):
    got = byte_bpe.round_trip(clashing).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = tokenizer.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.round_trip(empty).count() == 0
    ranks, pattern = byte_bpe.public_vocabulary()
    one, two = byte_bpe.encode_decode(odd, ranks, pattern), byte_bpe.decode(byte_bpe.encode(odd, ranks, pattern), ranks)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


# 9


def test_importance_prefers_the_target(spark, empty, clashing):
    docs = spark.createDataFrame([(i, EN if i % 2 else DE) for i in range(200)], "doc_id long, text string")
    target = docs.filter("doc_id % 2 = 1 and doc_id < 50")
    got = importance.resample(docs, target, share=0.5).collect()
    assert sum(r.kept for r in got) == 100 and all(r.kept == bool(r.doc_id % 2) for r in got)
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(clashing, empty, share=0.5).filter("kept").count() > 0
    assert importance.resample(docs, target, k=0).filter("kept").count() == 0


def test_weights_are_log_ratios(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "C d"), (3, None), (4, "")], "doc_id long, text string")
    target = docs.filter("doc_id = 1")
    ratio = importance.log_ratio(importance.count_grams(target), importance.count_grams(docs))
    got = {r.doc_id: r.log_weight for r in importance.resample(docs, target).collect()}
    for i, text in ((1, b"a b a"), (2, b"c d")):
        assert got[i] == pytest.approx(sum(ratio[b] for b in importance.gram_buckets(text, importance.BUCKETS)))
    assert got[3] == got[4] == 0
    assert got[1] > 0 > got[2]


@pytest.mark.parametrize("few", [1, 10_000])
def test_kth_largest(spark, monkeypatch, few):
    monkeypatch.setattr(importance, "FEW", few)
    values = [0.5, 3.0, 3.0, 3.0, -1.0, 2.0, 1e9]
    rows = spark.createDataFrame([(v, 2 * i, 1 + i % 3) for i, v in enumerate(values)], "key double, tie long, n long")
    every = sorted((v for i, v in enumerate(values) for _ in range(1 + i % 3)), reverse=True)
    for k in range(1, len(every) + 1):
        assert importance.kth_largest(rows, "key", k)[0] == every[k - 1]
    for k in (0, 1, 3, 7):
        assert rows.select(F.sum(importance.how_many(rows, k))).first()[0] == k


def test_gumbel_noise_is_gumbel(spark):
    got = [r.g for r in spark.range(4000).select(importance.gumbel(F.col("id")).alias("g")).collect()]
    assert np.mean(got) == pytest.approx(0.5772, abs=0.1) and np.std(got) == pytest.approx(math.pi / 6**0.5, abs=0.1)


def brute_importance(texts, target):
    """Log weights by the definition: words and neighbouring pairs in hashed buckets, one count in each before any text."""

    def buckets(text):
        h = [zlib.crc32(w.lower()) for w in words(text)]
        return [x % 10_000 for x in h] + [((a * 0x9E3779B1 & (1 << 64) - 1 ^ b) * 0x85EBCA6B & (1 << 64) - 1) >> 16 for a, b in zip(h, h[1:], strict=False)]

    def model(rows):
        count = Counter(b % 10_000 for t in rows for b in buckets(t))
        total = 10_000 + sum(count.values())
        return lambda b: math.log((count[b] + 1) / total)

    p, q = model([texts[i] for i in target]), model(texts)
    return [sum(p(b % 10_000) - q(b % 10_000) for b in buckets(t)) for t in texts]


def test_op9_is_what_the_definition_gives(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"W{i}" for i in rng.integers(0, 60 if k % 3 else 20, int(rng.integers(0, 30)))) for k in range(60)] + [None, "", "a", "a"]
    labels = [(i, i % 3 == 0, 0) for i in range(0, 50, 2)] + [(4, None, 0), (None, True, 0), (6, False, 1), (999, True, 0)]
    labels = [(i, None if q is None else int(q), t) for i, q, t in labels]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in importance.op9_importance(spark, str(tmp_path)).collect()}
    best = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            best[i] = max(best.get(i, 0), q)
    want = brute_importance(texts, [i for i in best if best[i] and i < len(texts)])
    assert [got[i].log_weight for i in range(len(texts))] == pytest.approx(want, abs=1e-9)
    kept = sorted(range(len(texts)), key=lambda i: -got[i].key)[: round(sum(best.values()) / len(best) * len(texts))]
    assert sorted(kept) == [i for i in range(len(texts)) if got[i].kept]


def test_repeated_rows_at_the_threshold_stay_as_there_is_room(spark):
    docs = spark.createDataFrame([(1, "a b")] * 7 + [(2, "c d")] * 3 + [(None, "e")] * 4, "doc_id long, text string")
    for k in range(15):
        got = importance.resample(docs, docs.filter("doc_id = 1"), k=k).collect()
        assert len(got) == 14 and sum(r.kept for r in got) == k


def test_importance_without_labels(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = importance.op9_importance(spark, str(tmp_path)).collect()
    assert len(got) == odd.count() and all(r.kept for r in got)


# 10

PAGES = "page_id long, url string, html string"


def test_revisits_refer_to_the_smallest_page(spark, tmp_path, spread):
    html = "<p>é 漢字</p>\r\nWARC/1.1\r\n\r\nContent-Length: 5\r\n"
    rows = [(5, "http://a/", html), (2, "http://b/", html), (9, None, html), (1, "u", ""), (3, "u", None), (4, "x\r\ny", "other"), (None, "n", "other"), (7, "t", "tie"), (7, "t", "tie"), (7, "t2", "tie"), (None, "n", None)]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("digest"), F.lit(2).alias("copies")), path)
    records = warc.read_archives(spark, path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.resolve(records).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    row = lambda page, kind, to, t: (page, kind, to, len((t or "").encode()), digest(t))
    want = [row(2, "response", None, html), row(5, "revisit", 2, html), row(9, "revisit", 2, html), row(1, "response", None, ""), row(3, "revisit", 1, ""), row(4, "response", None, "other"), row(None, "revisit", 4, "other")]
    want += [row(7, "response", None, "tie"), row(7, "revisit", 7, "tie"), row(7, "revisit", 7, "tie"), row(None, "revisit", 1, "")]
    assert got == sorted(want, key=str)
    assert records.select("record_id").distinct().count() == len(rows)


def test_op10_is_what_the_contract_says(spark, tmp_path, spread):
    rng = np.random.default_rng(41)
    rows = [(int(i), f"http://{i}/", None if i % 11 == 0 else "" if i % 13 == 0 else f"<p>{rng.integers(0, 60)}</p>") for i in rng.permutation(300)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op10_warc(spark, str(tmp_path)).collect()}
    first = {}
    for page, _, html in sorted(rows):
        first.setdefault(html or "", page)
    want = {}
    for page, _, html in rows:
        data, of = (html or "").encode(), first[html or ""]
        want[page] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if of == page else "revisit", None if of == page else of)
    with duckdb.connect() as con:  # the query's SQL sees repeats here
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert {r[0]: r[1:] for r in con.execute(warc.ORACLE).fetchall()} == want
    assert got == want


def test_long_pages_and_several_members_a_record(spark, tmp_path):
    path = f"file://{tmp_path}/long"
    long = "".join(map(chr, np.random.default_rng(1).integers(32, 127, 9_000_000))) * 2  # over the length of a member
    pages = spark.createDataFrame([(1, "a", long), (2, "b", "x"), (3, "c", long), (4, "d", None)], PAGES)
    warc.write_archives(pages, path)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve(warc.read_archives(spark, path)).collect()}
    assert got == {1: ("response", None, len(long)), 2: ("response", None, 1), 3: ("revisit", 1, len(long)), 4: ("response", None, 0)}


def test_archives_are_gzip_members_a_record(spark, tmp_path):
    import gzip
    import zlib as z

    warc.write_archives(spark.createDataFrame([(i, f"u{i}", f"page {i % 3}") for i in range(10)], PAGES).coalesce(1), f"file://{tmp_path}/members")
    members, kinds = 0, []
    for part in sorted((tmp_path / "members").glob("part-*")):
        data = part.read_bytes()
        kinds += [line for line in gzip.decompress(data).split(b"\r\n") if line.startswith(b"WARC-Type")]
        while data:
            one = z.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.1\r\n") and one.eof
            data, members = one.unused_data, members + 1
    assert members == 10 and kinds.count(b"WARC-Type: response") == 3


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_filters_that_let_pass_change_no_result(spark, monkeypatch, bits):
    monkeypatch.setitem(common.Bloom.__init__.__kwdefaults__, "bits", bits)
    rows = [(i % 40, None if i % 7 == 0 else f"k{i % 5}", i // 200) for i in range(400)] + [(None, None, 1)] * 5
    df = spark.createDataFrame(rows, "a long, b string, _first int")
    keys = df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"))
    chosen = F.coalesce(F.col("a"), F.lit(0)) % 3 == 0
    got = common.chosen_rows(df, ("a", "b"), keys.filter(chosen), keys.filter(~chosen).select("a", "b"), "test")
    assert got.columns == df.columns
    assert sorted({str((r[0], r[1])) for r in rows if (r[0] or 0) % 3 == 0}) == sorted(str((r.a, r.b)) for r in got.collect())


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("rows", "bits"), [(1 << 20, 1 << 20), (20, 1 << 20), (20, 64)])
def test_spread_joins_are_joins(spark, monkeypatch, rows, bits, how):
    monkeypatch.setattr(common, "SPREAD_ROWS", rows)
    monkeypatch.setattr(common, "SPREAD_BITS", bits)
    many = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", i % 2) for i in range(600)] + [(1, "hot", 0)] * 30
    one = {f"k{i}": i for i in range(0, 50, 2)} | {"hot": -1, "unused": -2}
    left = spark.createDataFrame(many, "id long, key string, _part int")
    right = spark.createDataFrame(list(one.items()), "key string, what long")
    got = [(r["id"], r["key"], r["_part"], r["what"]) for r in common.spread_join(left, right, "key", how).collect()]
    want = [(*row, one.get(row[1])) for row in many if how == "left" or row[1] in one]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert common.spread_join(left.limit(0), right, "key", how).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    path = f"file://{tmp_path}/small"
    warc.write_archives(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], PAGES), path, least_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, path).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.resolve(warc.read_archives(spark, path)).count() == 0


def test_half_the_tables_give_the_same_ids(vocabulary, tokenizer, monkeypatch):
    for name in ("MAX_STATES", "MAX_PAIRS", "MAX_PLANS", "MEMO_ROWS"):
        monkeypatch.setattr(byte_bpe, name, 60)
    encoder = byte_bpe.Encoder(*vocabulary, tables=0.5)
    assert (encoder.memo_rows, encoder.fst.max_states, encoder.fst.max_plans, encoder.fst.max_pairs) == (30, 30, 30, 30)
    for text in ("one two three " * 40, " ".join(f"w{i}x{i * 7}" for i in range(300))):
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == tokenizer.encode_ordinary(text)
    assert len(encoder.memo) <= 30
