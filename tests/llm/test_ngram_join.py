"""Operator 8 against brute force over all pairs."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from strandwise.llm import ngram_join as nj
from strandwise.llm import queries


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, size, num, den):
    """Smallest id reachable for each row; by union-find over all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
            common = len(x & y)
            if den * common >= num * (len(x) + len(y) - common):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = root(k)
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(sets[k]), i if not sets[k] else least.get(root(k))) for k, (i, _) in enumerate(rows))


def near_copies(seed, groups=12, template=True):
    rng = random.Random(seed)
    rows, boiler = [], [f"b{k}" for k in range(120)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([8, 30, 60, 150, 400]))]
        if template and g % 3 == 0:
            base = boiler + base[: rng.randrange(1, 14)]
        for _ in range(rng.choice([1, 2, 6, 15])):
            words = list(base)
            for _ in range(int(rng.random() * 0.06 * len(words)) + rng.randrange(2)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) + 1000, " ".join(words)))
    return rows


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_against_brute_force(make_docs, odd_texts, monkeypatch, size, num, den):
    monkeypatch.setattr(nj, "BLOCK", 4)
    rows = list(odd_texts) + near_copies(size)
    got = nj.linked_documents(make_docs(rows), shingle=size, similarity=(num, den)).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == components(rows, size, num, den)


@pytest.mark.parametrize("levels", ["rare", "frequent", "mixed"])
def test_linked_sets_share_a_signature_and_bitmaps_bound_them(levels):
    rng = np.random.default_rng(5)
    table = {"rare": np.zeros(1 << 20, np.uint8), "frequent": np.full(1 << 20, 90, np.uint8), "mixed": rng.integers(0, 120, 1 << 20).astype(np.uint8)}[levels]
    for num, den in ((9, 10), (8, 10)):
        for _ in range(150):
            n = int(rng.choice([2, 5, 20, 47, 50, 53, 60, 130, 400, 1500]))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            gone = rng.integers(0, max(1, n * (den - num) // den) + 1)
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[gone:]], rng.integers(0, 2**63, int(rng.integers(0, 3) * n // 60)).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            bits = int(np.bitwise_count(np.frombuffer(nj.bitmap(x), np.uint64) ^ np.frombuffer(nj.bitmap(y), np.uint64)).sum())
            assert bits <= len(x) + len(y) - 2 * common
            if den * common >= num * (len(x) + len(y) - common):
                assert len(np.intersect1d(nj.signatures(x, table, num, den), nj.signatures(y, table, num, den)))


def test_names_of_sets_are_proved(make_docs, monkeypatch):
    rows = near_copies(3, groups=4, template=False)
    calls = []
    real = nj._features

    def few_names(batches, size, seed, bits):
        import pyarrow as pa

        for batch in real(batches, size, seed, bits):
            i = batch.schema.get_field_index("node")
            yield batch if seed else batch.set_column(i, "node", pa.array([None if v is None else v % 3 for v in batch.column(i).to_pylist()], pa.int64()))

    monkeypatch.setattr(nj, "_features", few_names)
    got = nj.linked_documents(make_docs(rows)).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == components(rows, 3, 9, 10) and not calls


@pytest.mark.parametrize("piece", [16, 300, 1 << 20])
def test_word_hashes_name_words(monkeypatch, sf_docs, piece):
    monkeypatch.setattr(nj, "PIECE", piece)
    name, word = {}, {}
    for text in [d["text"] for d in sf_docs[:60 if piece < 1000 else 200]] + ["", " ", "a", "x" * 1000 + " y " + "x" * 1000, "\t a\x0bb\x0c", "q" * 299 + " " + "q" * 299, "é\u2003é \x1c"]:
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
        hashes = nj.word_hashes(text.encode()).tolist()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes):
            assert name.setdefault(w, h) == h and word.setdefault(h, w) == w


def test_empty(make_docs):
    assert nj.linked_documents(make_docs([])).count() == 0
    assert nj.one_of_each(make_docs([])).count() == 0


def test_one_of_each(make_docs, odd_texts):
    rows = list(odd_texts) + near_copies(9, groups=5)
    docs = make_docs(rows)
    out = nj.one_of_each(docs, shingle=5, similarity=(8, 10))
    want = components(rows, 5, 8, 10)
    keep = Counter({(i, n, c): k for (i, n, c), k in want.items() if n == 0})
    keep += Counter({(i, n, c): 1 for (i, n, c) in want if n and i == c})
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == sum((Counter({i: k}) for (i, _, _), k in keep.items()), Counter())


def test_query_over_a_table(spark, sf_docs):
    rows = [(d["doc_id"], d["text"]) for d in sf_docs]
    out = queries.op8_ngram_jaccard_join(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    sql = con.sql(queries.ORACLES["op8_ngram_jaccard_join"])
    assert out.columns == sql.columns and Counter(map(tuple, out.collect())) == components(rows, 3, 9, 10) == Counter(sql.fetchall())


def test_sql_agrees(make_docs, odd_texts):
    """On texts with few words, capitals and copies that are linked in chains."""
    rows = [r for r in odd_texts if r[0] not in (None, 9)] + near_copies(4, groups=8)
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    con = duckdb.connect()
    documents = make_docs(rows, extra=False).toArrow()
    con.register("documents", documents)
    for size, num, den in ((3, 9, 10), (5, 8, 10)):
        got = Counter(con.sql(nj.oracle_sql(size, (num, den))).fetchall())
        assert got == components(rows, size, num, den)


def test_ids_and_texts_of_the_same_bytes_are_told_apart(make_docs):
    rows = [(7523094288207667809, None), (None, "abcdefgh"), (3, "x y z w")]
    got = nj.one_of_each(make_docs(rows), shingle=5, similarity=(8, 10)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
