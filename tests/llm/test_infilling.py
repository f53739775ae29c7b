"""Operator 13 against units cut one by one, and its SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

from strandwise.llm import infilling, queries

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def one(i, text, rate=50, spm_rate=80):
    text = text or ""
    u = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(h[k] % (len(u) + 1) for k in (0, 1))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm_rate:
        return i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm_rate, batch", [(50, 80, 1 << 22), (100, 50, 64)])
def test_equals_the_units_cut_one_by_one(make_docs, odd_texts, sf_docs, monkeypatch, rate, spm_rate, batch):
    monkeypatch.setattr(infilling, "BATCH_BYTES", batch)
    more = ["<P>", "a <S> b", "<M", "<", "x <P", "> y", "\t\t", "    é ü ", "a", " a", "a ", "日本\n語 \U0001f600", "long é word " * 500_000]
    rows = odd_texts + [(100 + n, t) for n, t in enumerate(more)] + [(1000 + d["doc_id"], d["text"]) for d in sf_docs]
    got = infilling.restored_texts(infilling.fill_in_middle(make_docs(rows), rate=rate, spm_rate=spm_rate)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(one(i, t, rate, spm_rate) for i, t in rows)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, t or "") for i, t in rows)
    assert len({r.form for r in got}) == 3


def test_own_sentinels(make_docs):
    got = infilling.fill_in_middle(make_docs([(i, "some words <P> here") for i in range(40)]), rate=100, sentinels=("⟨p⟩", "⟨s⟩", "⟨m⟩"))
    rows = infilling.restored_texts(got, sentinels=("⟨p⟩", "⟨s⟩", "⟨m⟩")).collect()
    assert all(r.form != "plain" and r.restored == "some words <P> here" and "⟨m⟩" in r.output for r in rows)
    with pytest.raises(ValueError, match="sentinels"):
        infilling.fill_in_middle(make_docs([]), sentinels=("<P>", "<P>", "<M>"))


def test_empty(make_docs):
    assert infilling.infilling_digest(infilling.fill_in_middle(make_docs([]))).count() == 0


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert Counter(map(tuple, queries.op13_infilling(spark, SF).collect())) == Counter(con.sql(infilling.oracle_sql()).fetchall())


def test_sql_agrees_on_odd_rows(make_docs, odd_texts):
    docs = make_docs(odd_texts + [(50, "<P> x"), (51, "é <M>"), (52, " \n")], extra=False).toArrow()
    con = duckdb.connect()
    con.register("documents", docs)
    want = Counter(con.sql(infilling.oracle_sql()).fetchall())
    got = infilling.infilling_digest(infilling.fill_in_middle(make_docs(odd_texts + [(50, "<P> x"), (51, "é <M>"), (52, " \n")])))
    assert Counter(map(tuple, got.collect())) == want
