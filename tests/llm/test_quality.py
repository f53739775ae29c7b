"""Operator 7 against brute force and DuckDB."""

import re
from collections import Counter, defaultdict

import duckdb

from strandwise.llm import quality, queries


def brute(rows, min_documents, share, least_left=0.30):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    normal = lambda t: "".join("0" if "1" <= c <= "9" else c.lower() if c.isascii() else c for c in " ".join(words(t)))
    holders, texts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            holders[host, normal(line)].add(text or "")
    out = []
    for i, text, host in rows:
        text = text or ""
        w = words(text)
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k for n in range(len(w) - 2) if tri[tuple(w[n : n + 3])] > 1 for k in (n, n + 1, n + 2)}
        lines = [x for x in text.split("\n") if words(x)]
        gone = sum(len(words(x)) for x in lines if (n := len(holders[host, normal(x)])) > min_documents and n > share * len(texts[host]))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        left = len(w) - gone
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, left, not failed and 100 * left >= 100 * least_left * len(w)))
    return Counter(out)


def rows_of(odd_texts):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits are alike in normal lines
    own = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(60))
    menu, small = " ".join(f"menu{k}" for k in range(30)), "Read more 12 items"
    rows = [(i, t, "h") for i, t in odd_texts]
    rows += [(100 + i, own(i) + f"\n{small}\n{menu}", "h") for i in range(12)]
    rows += [(200 + i, "\n".join([f"a{i}"] + [menu, menu.upper()]), "h") for i in range(6)]
    rows += [(300 + i, own(7000) + "\n" + own(7001), "h") for i in range(30)]  # copies don't make lines frequent
    rows += [(400 + i, own(i) + f"\n{small}\nread  more 35 items", None) for i in range(9)]
    rows += [(500, "a b c " * 40, "g"), (501, "# $ % & | < > *\n" * 3, "g"), (502, own(1) + "\n" + own(1), None)]
    return rows


def test_against_brute_force(make_docs, odd_texts):
    rows = rows_of(odd_texts)
    got = quality.judged_documents(make_docs(rows), min_documents=5, share=0.1).drop("rk", "removed").collect()
    want = brute(rows, 5, 0.1)
    assert Counter(map(tuple, got)) == want
    verdict = {r.doc_id: r.kept for r in got}
    assert all(verdict[100 + i] for i in range(12)) and not any(verdict[200 + i] for i in range(6)) and all(verdict[300 + i] for i in range(30))


def test_null_and_empty_texts_are_one_document(make_docs):
    line = " ".join(f"menu{k}" for k in range(30))
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(i, " ".join(f"w{letters(i)}x{letters(k)}" for k in range(60)) + (f"\n{line}" if i < 6 else ""), "h") for i in range(18)] + [(90, None, "h"), (91, "", "h")]
    got = quality.judged_documents(make_docs(rows), min_documents=5, share=6 / 19.5).drop("rk", "removed").collect()  # 6 of 19, not of 20
    assert Counter(map(tuple, got)) == brute(rows, 5, 6 / 19.5) and any(r.left_words < r.n_words for r in got)


def test_copies_count_where_they_are_asked_to(make_docs):
    text = "\n".join(" ".join(f"{c}{k}" for c in "abcdefgh") for k in ("x", "y", "z", "u", "v", "w", "t"))
    rows = [(i, text, "h") for i in range(30)] + [(100 + i, f"{'own word here ' * 2}{chr(97 + i)} " * 20, "h") for i in range(5)]
    once, each = (quality.judged_documents(make_docs(rows), count_copies=c, min_documents=5, share=0.1).where("doc_id < 100").collect() for c in (False, True))
    assert all(r.kept and r.removed is None for r in once) and not any(r.kept for r in each) and all(r.left_words == 0 for r in each)


def test_cleaned_documents(make_docs, odd_texts):
    rows = rows_of(odd_texts)
    out = quality.cleaned_documents(make_docs(rows), keep=("lang", "source"), min_documents=5, share=0.1)
    assert out.columns == ["doc_id", "lang", "source", "text"]
    texts = {r.doc_id: r.text for r in out.collect()}
    kept = {r[0] for r in brute(rows, 5, 0.1) if r[-1]}
    assert set(texts) == kept
    assert texts[100] == dict((r[0], r[1]) for r in rows)[100].split("\n")[0] and texts[300] == dict((r[0], r[1]) for r in rows)[300]


def test_empty(make_docs):
    assert quality.judged_documents(make_docs([])).count() == 0
    assert quality.cleaned_documents(make_docs([])).count() == 0


def test_sql_agrees(spark, sf_docs):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = queries.op7_quality_rules(spark, "/root/testdata/sf0.001")
    found = con.sql(f"select {', '.join(got.columns)} from ({quality.oracle_sql()})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(found) == brute([(d["doc_id"], d["text"], d["source"]) for d in sf_docs], quality.MIN_DOCUMENTS, quality.SHARE)
