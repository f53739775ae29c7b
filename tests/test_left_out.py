"""Hits that are left out where they are found: the same as by shuffles of all hits, which only longer sequences and shared names take."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandwise import catalog
from strandwise.operators import matching, scan, searching
from test_matching import HIT, edit_distance, frames, rc, starts_brute, thin_brute

SF = "/root/testdata/sf0.001"


def rows(hits):
    return Counter(map(tuple, hits.select(*HIT).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def case():
    """Repeats, reads that both strands have, and a sequence of more than one piece with hits at its edge."""
    rng = random.Random(5)
    long = "".join(rng.choice("ACGT") for _ in range(scan.PIECE + 900))
    refs = ["ACGT" * 40 + "A" * 60, "".join(rng.choice("ACGT") for _ in range(900)), "", long]
    reads = [("p", "ACGTACGTACGT"), ("a", "AAAAAAAAAAAA"), ("q", "ACGTTGCAACGT")]
    reads += [(f"e{n}", long[scan.PIECE - 20 + 3 * n :][: 16 + n]) for n in range(6)] + [(f"s{n}", rc(refs[1][50 * n :][: 14 + n])) for n in range(6)]
    return reads, refs


def test_edit_hits_are_thinned_where_they_are_found(spark, case):
    reads, refs = case
    for some in (refs, refs[:3]):
        own = frames(spark, reads, some)
        assert rows(matching.edit_match(*own, 2)) == rows(matching.nonredundant(matching.edit_starts(*own, 2), 2))
    own = frames(spark, reads, refs[:1])
    assert rows(matching.edit_match(*own, 2)) == thin_brute(starts_brute(reads, refs[:1], 2), 2)
    assert "read_id#" not in "".join(x for x in plan(matching.edit_match(*own, 2)).splitlines() if "Exchange" in x)


def test_second_strands_are_left_out_where_they_are_found(spark, case):
    reads, refs = case
    r, f = frames(spark, reads, refs)
    for k in (0, 1, 3):
        want = rows(matching.one_strand(scan.scan(r, f, k, "hamming", 30)))
        assert rows(matching.hamming_match(r, f, k)) == want
        if k:
            assert rows(searching.match(r, scan.pieces(f, 40, 40), k, "minU", alone=True)) == want == rows(searching.match(r, scan.pieces(f, 40, 40), k, "minU"))
    for name in ("hamming_k2", "scheme_hamming_k3"):
        assert "Aggregate" not in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("which", ["reads", "sequences"])
def test_shared_names_are_one_group(spark, case, which):
    """Reads of one name, and sequences of one number, are thinned together."""
    reads, refs = case[0], case[1][:3]
    r, f = frames(spark, reads, refs)
    if which == "reads":
        r = r.unionByName(spark.createDataFrame([("p", "CCGTACGTACGT"), ("p", "ACGTACGTAC"), ("a", "AAAAAAAAAAAA")], r.schema))
    else:
        f = f.unionByName(spark.createDataFrame([(0, "again", "TACGT" * 30 + "A" * 14)], f.schema))
    assert rows(matching.edit_match(r, f, 2)) == rows(matching.nonredundant(matching.edit_starts(r, f, 2), 2))
    assert rows(matching.hamming_match(r, f, 1)) == rows(matching.one_strand(matching.hamming_match(r, f, 1, distinct=False)))


def test_words_bound_distances():
    """Of texts of ACGT they give them; other letters only lower them."""
    rng = random.Random(2)
    for letters in ("AC", "ACGT", "ACGTN"):
        texts = [np.frombuffer("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))).encode(), np.uint8) for _ in range(300)]
        patterns = []
        for t in texts:  # near to their text, or not
            p = list(t.tobytes().decode())
            for _ in range(rng.randrange(6)):
                x = rng.randrange(len(p) + 1)
                p[x : x + rng.randrange(2)] = rng.choice([[], [rng.choice(letters)]])
            patterns.append(np.frombuffer("".join(p).encode() or b"A", np.uint8))
        word = lambda some: np.array([scan.words(x)[0][0] for x in some])
        for k in (1, 2, 3):
            size = np.array([min(len(p), len(t), 32 - k) for p, t in zip(patterns, texts)])
            got = scan.word_errors(word(texts), word(patterns), size, k)
            for p, t, n, e in zip(patterns, texts, size.tolist(), got.tolist()):
                want = min(edit_distance(p[:n].tolist(), t[:j].tolist()) for j in range(min(len(t), n + k) + 1))
                # behind a text come As in its word
                assert e <= want if "N" in letters or len(t) < n + k else e == min(want, k + 1)
        n = np.minimum([len(p) for p in patterns], [len(t) for t in texts]).clip(max=32)
        got = scan.word_distance(word(texts), word(patterns), np.uint64(0x5555555555555555) >> (64 - 2 * n).astype(np.uint64))
        want = [int((t[:i] != p[:i]).sum()) for t, p, i in zip(texts, patterns, n.tolist())]
        assert (got <= want).all() and ("N" in letters or got.tolist() == want)
    text = np.frombuffer(b"".join(t.tobytes() for t in texts), np.uint8)
    ahead, behind = scan.words(text)
    at = np.arange(len(text) + 1)
    assert (scan.words_at(text, at) == ahead).all() and (scan.words_at(text, at - 1, -1) == behind).all()


@pytest.mark.parametrize("metric", ["edit", "hamming"])
def test_most_candidates_are_ruled_out_by_words(metric):
    """Reads of 12 letters have seeds of 4, which stand at every 256th letter; hits are far fewer."""
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(20000))
    reads = [(f"r{n}", "".join(rng.choice("ACGT") for _ in range(12 + n % 30))) for n in range(40)] + [("own", text[700:740])]

    class Count(list):
        add = list.append

    class shared:
        value = scan.Patterns(reads, 2)

    class counters:
        places, candidates, verified = Count(), Count(), Count()

    cut = scan._cut([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], names=["seq_idx", "seq"])], 50, 50)
    found = [r for b in scan._match(cut, shared, 2, metric, counters) for r in b.to_pylist()]
    assert {"read_id": "own", "strand": "FW", "seq_idx": 0, "begin": 700, "end": 740, "distance": 0} in found
    assert sum(counters.places) > 10 * sum(counters.candidates) and sum(counters.candidates) <= 4 * len(found) == 4 * sum(counters.verified)
