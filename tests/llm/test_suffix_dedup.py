"""Operator 3 against brute force over all strings of 400 bytes."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from strandwise.llm import common, queries
from strandwise.llm import suffix_dedup as sd


def brute(rows):
    raw = [(t or "").encode() for _, t in rows]
    n = Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    out = Counter()
    for (i, _), x in zip(rows, raw):
        gone = np.zeros(len(x) + 2, bool)
        for k in range(len(x) - 399):
            if n[x[k : k + 400]] > 1:
                gone[k + 1 : k + 401] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[1:-1]]) if x else b""
        out[i, len(x), int(gone.sum()), int((gone[1:] > gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    words = [f"{rng.randrange(16**4):x}" for _ in range(300)] + ["é", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(k) for k in (60, 75, 90, 100, 120, 200)]
    exact = "q" * 20 + text(200)[:380]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(5, 150)) for _ in range(3)]
        if i % 3:
            parts.insert(rng.randrange(3), rng.choice(shared))
        if i % 4 == 0:
            parts.insert(1, exact[: 395 + rng.randrange(8)])
        rows.append((1000 + i, " ".join(parts)))
    base = text(400)
    for i in range(12):  # near copies
        x = list(base)
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = "#"
        rows.append((2000 + i, "".join(x)))
    rows += [(3000, base), (3000, base), (3001, text(100) + base[300:900] + text(20) + base[300:900]), (3002, "ab" * 900), (3003, "x" * 450), (3004, "y" * 400), (3005, "z" * 399)]
    return rows


def digests(removed):
    rows = removed.collect()
    assert all(r.n_removed or len(r.text.encode()) == r.n_bytes for r in rows)
    return Counter(r[:5] for r in rows)


@pytest.mark.parametrize("group", [4096, 30])
def test_against_brute_force(make_docs, odd_texts, monkeypatch, group):
    rows = [(i, t) for i, t in odd_texts if not t or len(t) < 10_000] + passages(1)
    monkeypatch.setattr(sd, "GROUP", group)  # pivots split some groups, or all
    if group == 30:
        monkeypatch.setattr(common, "MOST_KEYS", 3)  # and all texts are joined
    assert digests(sd.repeat_digest(sd.remove_repeats(make_docs(rows)))) == brute(rows)


def test_a_passage_that_very_many_documents_share(make_docs, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"{rng.randrange(16**5):x}"
    passage = " ".join(word() for _ in range(110))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(90))) + " " + passage + " " + " ".join(word() for _ in range(rng.randrange(90)))) for i in range(200)]
    rows += [(1000 + i, rows[0][1][:k] + "#" + rows[0][1][k:]) for i, k in enumerate(range(0, len(rows[0][1]), 25))]
    monkeypatch.setattr(sd, "GROUP", 60)
    assert digests(sd.repeat_digest(sd.remove_repeats(make_docs(rows)))) == brute(rows)


def test_long_texts_are_whole(make_docs, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, "start" + long[12_000:12_600] + "end"), (3, long[29_500:])]
    monkeypatch.setattr(sd, "BLOCK", 1000)
    p, _ = sd.anchors(np.frombuffer(long.encode(), np.uint8))
    monkeypatch.setattr(sd, "BLOCK", sd.PLACES - 400)
    assert np.array_equal(p, sd.anchors(np.frombuffer(long.encode(), np.uint8))[0])
    assert digests(sd.repeat_digest(sd.remove_repeats(make_docs(rows)))) == brute(rows)


def contexts(seed, n, alphabet="ab"):
    rng = random.Random(seed)
    base = "".join(rng.choice(alphabet) for _ in range(736)).encode()
    rows = []
    for _ in range(n):
        x = bytearray(base)
        for _ in range(rng.randrange(3)):
            x[rng.choice([k for k in range(736) if not 336 <= k < 400])] = 122
        lo, hi = rng.randrange(0, 337) * rng.randrange(2), 736 - rng.randrange(0, 300) * rng.randrange(2)
        rows.append((336 - lo, bytes(x[lo:hi])))
    return rows


def test_sort_is_a_sort():
    rows = contexts(4, 40)
    c = sd.Contexts([(336, x.ljust(736, b"a")[:736]) for _, x in rows])
    group = np.repeat([0, 1, 2, 3], [1, 20, 2, 17])
    start, length = np.full(40, 100), np.full(40, 500)
    order = sd.sort_suffixes(c, np.arange(40), group, start, length)
    want = sorted(range(40), key=lambda i: (group[i], c.data[i, 100:600].tobytes(), i))
    assert order.tolist() == want


@pytest.mark.parametrize("weak", [False, True])
def test_collisions_are_found(monkeypatch, weak):
    if weak:  # hashes that hardly tell strings apart
        real = sd.prefix_hashes
        monkeypatch.setattr(sd, "prefix_hashes", lambda data: real(data) & np.uint64(0))
    rows = contexts(7, 30) + contexts(8, 30)
    c = sd.Contexts(rows)
    group = np.repeat([0, 1], 30)
    done = np.zeros(60, bool)
    done[5] = True
    got = {(i, o) for i, u, v in sd.repeated_starts(c, group, done) for o in range(u, v + 1)}
    strings = Counter((g, o, x[left - o : left - o + 400]) for g, (left, x) in zip(group, rows) for o in range(337) if left >= o and len(x) - left >= 400 - o)
    want = {(i, o) for i, (left, x) in enumerate(rows) if i != 5 for o in range(337) if left >= o and len(x) - left >= 400 - o and strings[group[i], o, x[left - o : left - o + 400]] > 1}
    assert got == want


def test_empty(make_docs):
    assert sd.remove_repeats(make_docs([])).count() == 0


def test_query_over_a_table(spark, sf_docs):
    rows = [(d["doc_id"], d["text"]) for d in sf_docs]
    out = queries.op3_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert digests(out) == brute(rows)
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    sql = con.sql(queries.ORACLES["op3_suffix_dedup"])
    assert out.columns == sql.columns and Counter(map(tuple, out.collect())) == Counter(sql.fetchall())


def test_planted_passages_go_and_clean_documents_stay(make_docs):
    """Passages of 51 to 120 words, each in some documents among words of their own. What is shorter than 400 bytes is out by contract."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in range(51, 121, 3)]
    rows, planted = [], {}
    for i in range(240):
        own = passages[i % len(passages)] if i < 120 else None
        rows.append((i, " ".join(filter(None, [words(rng.randrange(5, 60)), own, words(rng.randrange(5, 60))]))))
        planted[i] = own
    got = {r.doc_id: r for r in sd.repeat_digest(sd.remove_repeats(make_docs(rows))).collect()}
    long = [i for i, own in planted.items() if own and len(own) >= 400]
    short = [i for i, own in planted.items() if own and len(own) < 398]  # with a space on both sides
    assert len(long) >= 30 and len(short) >= 20
    assert all(got[i].n_removed >= len(planted[i]) and planted[i] not in got[i].text for i in long)
    assert all(got[i].n_removed == 0 and got[i].text == rows[i][1] for i in [*short, *range(120, 240)])
