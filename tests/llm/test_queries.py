"""The registered queries of the corpus operators on the smallest tables, against SQL or brute force."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from rillspark.llm import common, language_id, queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_what_sql_says(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF_DIR)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"pipeline", "op11_chat_windows"}))
def test_a_row_for_each_input_row(spark, name):
    table = "pages" if name == "op10_warc" else "documents"
    key = "page_id" if name == "op10_warc" else "doc_id"
    got = sorted(r[0] for r in queries.QUERIES[name](spark, SF_DIR).select(key).collect())
    assert got == sorted(r[0] for r in common.read_table(spark, SF_DIR, table).select(key).collect())


def test_held_out_accuracy(spark):
    docs = common.read_table(spark, SF_DIR, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in queries.QUERIES["op3_language_id"](spark, SF_DIR).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)
    assert language_id.train_on(docs).languages == sorted(set(lang.values()))


def test_every_stage_takes_effect(spark):
    docs = common.read_table(spark, SF_DIR, "documents")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, SF_DIR), f"test-{name}")
        if name != "byte_bpe":
            assert out.columns == columns
        if name in ("language_id", "exact_dedup", "simhash"):
            kept = [r.doc_id for r in out.select("doc_id").collect()]
            assert len(kept) == len(set(kept))
            assert set(kept) <= (ids or set(kept))
            ids = set(kept)
        if name == "exact_dedup":
            texts = [r.text.lower() for r in out.collect()]
            assert len(texts) == len(set(texts))
        docs = out
    assert {r.doc_id for r in docs.collect()} <= ids


def test_the_pipeline_against_brute_force(spark, tmp_path):
    """Exact copies by lower-cased text, then groups of similar shingle sets; what stays is mixed and encoded as the tokenizer does."""
    import hashlib
    from collections import Counter

    import numpy as np
    import tiktoken

    from rillspark.llm import byte_bpe, mixing

    docs = [tuple(r) for r in common.read_table(spark, SF_DIR, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng, top = np.random.default_rng(3), max(d[0] for d in docs)
    long = [d for d in docs if len(d[1].split()) > 100][:12]
    for k, d in enumerate(long):  # exact copies, near copies, and texts that are none
        words = d[1].split()
        words[int(rng.integers(len(words)))] = "changed"
        docs += [(top + 3 * k + 1, d[1].upper(), *d[2:]), (top + 3 * k + 2, " ".join(words), *d[2:]), (top + 3 * k + 3, "123 456 !", *d[2:])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = {}
    for d in sorted(docs):
        if any(c.isalpha() for c in d[1]):
            kept[d[1].translate(lower)] = d
    kept = sorted(kept.values())
    grams = []
    for d in kept:
        w = d[1].translate(lower).encode().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = [d for i, d in enumerate(kept) if root[i] == i]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    frame = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.taken(frame).collect() if r["size"]}  # tested against its own brute force
    ranks, pattern = byte_bpe.public_vocabulary()
    tokenizer = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.parse_ranks(ranks), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for d in kept:
        ids = tokenizer.encode_ordinary(d[1])
        want[d[0], len(ids), sha(",".join(map(str, ids)).encode()), sha(d[1].encode())] = times[d[0]]
    assert got == +want
