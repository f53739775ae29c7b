"""Operator 6 against its definition in plain Python and in DuckDB."""

import re
from collections import defaultdict

import duckdb
import pytest

from strandwise.llm import mixing


def targets(sizes, weights=(1, 2, 3), repeats=3):
    """Share by weight, stop at the caps, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: float(repeats * sizes[s]) for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_targets_and_takes(make_docs):
    rows = [(i, "w " * (1 + i * 7 % 40), s) for i, s in enumerate("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaabbbbcccccdée")]
    rows += [(100, None, "a"), (101, "", None), (102, "one two", None), (103, " \t\x0b", "f"), (None, "x y z", "a"), (104, "u v w", "\U0001f600"), (105, "q r s", "￿")]
    got = mixing.mix_sources(make_docs(rows)).collect()
    check(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(make_docs(rows)).collect()))


def test_null_and_repeated_ids_come_near_the_target(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBER_PARTS", 3)
    rows = [(None, f"{i} a b c d", "hot") for i in range(400)] + [(None, "w x y", "hot")] * 300 + [(7, "same text here now", "b")] * 200 + [(i, "u v", "c") for i in range(50)]
    docs = make_docs(rows)
    got = mixing.mix_sources(docs).collect()
    check(rows, got)
    again = mixing.mix_sources(make_docs(rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken, found = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.source, r.size] += r.taken
    for r in mixing.mixed_documents(docs).collect():
        found[r.source, len(r.text.split())] += len(r.text.split())
    assert found == {k: n for k, n in taken.items() if n}
    con = duckdb.connect()
    con.register("documents", make_docs(rows, extra=False).toArrow())
    want = con.sql(mixing.oracle_sql()).fetchall()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in got)


def test_empty(make_docs):
    assert mixing.mix_sources(make_docs([])).count() == 0
    assert mixing.mixed_documents(make_docs([])).count() == 0


def test_mixed_documents_are_the_taken_rows(make_docs):
    docs = make_docs([(i, "w " * (1 + i % 9) if i % 7 else "", "abc"[i % 3] if i % 4 else "hot") for i in range(200)])
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(docs).collect() if r.size and r.taken}
    out = mixing.mixed_documents(docs)
    found = defaultdict(int)
    for r in out.collect():
        found[r.doc_id] += 1
    assert found == taken and out.columns == docs.columns


def test_sql_agrees(spark):
    from strandwise.llm.queries import op6_mixing

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, op6_mixing(spark, sf).collect())) == sorted(con.sql(mixing.oracle_sql()).fetchall())
