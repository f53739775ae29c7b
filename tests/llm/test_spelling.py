"""Operator 12 against all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandwise.llm import queries, spelling


def words_of(rows, every=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(n):
    form, count = {}, {}
    by = {}
    for w in n:  # pairs share a word with one code point less, or are one
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(x, set()).add(w)
    for w in n:
        found = {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by[x] if near(w, v)}
        count[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n}


def table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("group, chunk", [(1 << 14, 1 << 16), (3, 40)])
def test_variants_equal_brute_force(spark, monkeypatch, group, chunk):
    monkeypatch.setattr(spelling, "GROUP_ROWS", group)
    monkeypatch.setattr(spelling, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(4)
    n = {}
    for _ in range(700):
        w = "".join(rng.choice(list("abé"), rng.integers(5, 10)))
        n[w] = int(rng.integers(3, 60))
    n |= {"a" * k: 2 ** (12 - k) * 3 for k in range(5, 12)}  # a chain, and insertions within equal letters
    n |= {"z" * 3000: 5, "z" * 2999: 50, "z" * 2998 + "y": 3}
    got = spelling.spelling_variants(table(spark, n)).collect()
    assert len(got) == len(n) and {tuple(r) for r in got} == brute(n)
    pairs = [frozenset((r.word, r.near)) for r in spelling.near_pairs(table(spark, n)).collect()]
    assert len(pairs) == len(set(pairs)) == sum(x[4] for x in brute(n)) // 2 and all(near(*p) for p in pairs)


def test_a_hot_prefix_is_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_ROWS", 50)
    rng = np.random.default_rng(8)
    n = {"commonprefix" + "".join(rng.choice(list("abcd"), 12)): int(rng.integers(3, 9)) for _ in range(400)}
    n |= {w[:15] + "e" + w[16:]: 40 for w in list(n)[:100]}
    rows = spelling._split(spelling._grouped(table(spark, n)))
    sizes = rows.where("L - a - z > 1").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 50
    assert {tuple(r) for r in spelling.spelling_variants(table(spark, n)).collect()} == brute(n)


def test_vocabulary_and_misspellings(make_docs, odd_texts):
    rows = odd_texts + [(i, "Straße ÉTÉS étés Étés naïve×÷ naïve worlds WORLDS x1y Ārea " * 3 + "ÿ" * 30) for i in range(300)] + [(-7, "worldz " * 4), (None, "worlds " * 9)]
    for every in (97, 3, 0):
        got = {r.word: r.n for r in spelling.vocabulary(make_docs(rows), misspell_every=every).collect()}
        assert got == words_of(rows, every) and len(got) > 3


def test_empty(spark, make_docs):
    assert spelling.document_variants(make_docs([])).count() == 0
    assert spelling.document_variants(make_docs([(1, None), (2, "a b")])).count() == 0


def test_query_over_a_table(spark, sf_docs):
    got = queries.op12_spelling(spark, "/root/testdata/sf0.001").collect()
    want = brute(words_of([(d["doc_id"], d["text"]) for d in sf_docs]))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
