"""Operator 5 against brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strandwise.llm import line_dedup, quality, queries


LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    for n, (i, text, *_) in enumerate(rows):
        for key in {k for line in (text or "").split("\n") if len(k := line.strip(" \t\n\x0b\x0c\r").translate(LOWER)) >= min_chars}:
            holders[key].append(i)
    out = []
    for i, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            has = holders.get(line.strip(" \t\n\x0b\x0c\r").translate(LOWER), [])
            ids = [x for x in has if x is not None]
            if len(has) < min_docs or not ids or i == max(ids):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_against_brute_force(make_docs, odd_texts):
    a, b = "An often repeated line of at least forty characters, É", "  Another repeated line with more than forty characters\t"
    rows = list(odd_texts) + [(100 + i, f"own {i}\n{a.upper() if i % 2 else a}\n{b if i < 4 else ''}\n{a}\nend") for i in range(9)]
    rows += [(200, a), (200, a), (None, a), (201, "short\n" * 50), (202, b), (203, a + "\n" + b.strip().lower())]
    rows += [(None, "only documents without an id hold this rather long line")] * 6
    got = line_dedup.line_digest(line_dedup.drop_repeated_lines(make_docs(rows)))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_filter_never_misses_a_repeat_and_merges(make_docs, sf_docs, monkeypatch):
    rows = [(d["doc_id"], d["text"]) for d in sf_docs]
    docs = make_docs(rows)
    bits, functions = line_dedup.twice_seen(docs, "text", 40)
    keys = Counter(k for _, t in rows for k in line_dedup._document_keys(t, 40))
    hashes = np.frombuffer(b"".join(map(line_dedup.key_hash, keys)), "<u8").reshape(-1, 2)
    at = line_dedup.probes(hashes, 8 * len(bits), functions).astype(np.int64)
    seen = np.unpackbits(bits)[at].all(1)
    many = np.array([n > 1 for n in keys.values()])
    assert seen[many].all() and seen[~many].mean() < 0.1
    # a filter that is far too small suspects everything, and results stay the same
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(line_dedup, "SEGMENT", 1 << 10)
    got = line_dedup.line_digest(line_dedup.drop_repeated_lines(docs))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_hash_functions_follow_the_load():
    """With bits held at a cap, fewer functions suspect fewer keys; the estimate is near what a filter does."""
    assert [line_dedup.hash_functions(n, 1 << 20) for n in (0, 1 << 16, 1 << 20, 1 << 22)] == [4, 4, 1, 1]
    rng, bits = np.random.default_rng(7), 1 << 20
    for keys in (1 << 17, 1 << 19, 1 << 20):
        hashes = rng.integers(0, 2**63, (keys, 2)).astype(np.uint64)
        share = {}
        for n in (1, 4):
            at = line_dedup.probes(hashes, bits, n)
            share[n] = (np.bincount(at.ravel().astype(np.int64), minlength=bits)[at.astype(np.int64)] > 1).all(1).mean()
        best = line_dedup.hash_functions(keys, bits)
        assert line_dedup.suspected(keys, bits, best) <= min(line_dedup.suspected(keys, bits, n) for n in (1, 4))
        assert (share[1] < share[4]) == (line_dedup.suspected(keys, bits, 1) < line_dedup.suspected(keys, bits, 4))


def test_empty(make_docs):
    assert line_dedup.drop_repeated_lines(make_docs([])).count() == 0


def test_columns_that_are_kept(make_docs):
    out = line_dedup.drop_repeated_lines(make_docs([(1, None), (2, "x")]), keep=("lang", "source", "size"))
    assert out.columns == ["doc_id", "lang", "source", "size", "text", "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.size) for r in out.collect()} == {(1, None, "clash"), (2, "x", "clash")}


def test_sql_agrees(spark, sf_docs):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = Counter(map(tuple, queries.op5_line_dedup(spark, "/root/testdata/sf0.001").collect()))
    assert got == Counter(con.sql(line_dedup.oracle_sql()).fetchall()) == brute([(d["doc_id"], d["text"]) for d in sf_docs])


def test_kept_columns_may_have_internal_names(make_docs):
    rows = [(i, "A line of at least forty characters that five documents hold") for i in range(6)]
    names = ("rk", "hash", "lost_id", "lost_rk", "dropped", "keeper", "of", "of_rk", "removed", "_rk", "_text", "_id")
    for out in (line_dedup.drop_repeated_lines(make_docs(rows), keep=names), quality.cleaned_documents(make_docs([(i, "word " * 30 + f"other{i} text " * 20) for i in range(3)]), keep=names)):
        assert all(r[n] == "clash" for r in out.collect() for n in names)
    for f in (line_dedup.drop_repeated_lines, quality.cleaned_documents):
        with pytest.raises(ValueError, match="text"):
            f(make_docs(rows), keep=("text",))
