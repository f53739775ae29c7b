"""Matching against brute force over all windows, the redundancy filter, and the deliberate deviations."""

import itertools
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandwise.operators import matching, reporting, scan
from strandwise.plans.mapping import MapConfig, map_reads

HIT = ("read_id", "strand", "seq_idx", "begin", "end", "distance")


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def frames(spark, reads, refs):
    return spark.createDataFrame(reads, "read_id string, seq string"), spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(refs)], "seq_idx long, name string, seq string")


def strands(reads):
    return [(i, s, p) for i, r in reads for s, p in (("FW", r), ("RC", rc(r))) if r]


def hamming_brute(reads, refs, k):
    best = {}
    for (i, s, p), (j, t) in itertools.product(strands(reads), enumerate(refs)):
        for b in range(len(t) - len(p) + 1):
            d = sum(x != y for x, y in zip(p, t[b:]))
            if d <= k:
                key = (i, j, b, b + len(p), d)
                best[key] = min(best.get(key, s), s)
    return {(i, s, j, b, e, d) for (i, j, b, e, d), s in best.items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def starts_brute(reads, refs, k):
    out = set()
    for (i, s, p), (j, t) in itertools.product(strands(reads), enumerate(refs)):
        for b in range(len(t)):
            found = min(((edit_distance(p, t[b:e]), e) for e in range(max(b + 1, b + len(p) - k), min(len(t), b + len(p) + k) + 1)), default=(k + 1, 0))
            if found[0] <= k:
                out.add((i, s, j, b, found[1], found[0]))
    return out


def thin_brute(hits, k):
    groups = defaultdict(list)
    for h in hits:
        groups[h[0], h[2]].append(h)
    out = []
    for rows in groups.values():
        kept = []
        for h in sorted(rows, key=lambda h: (h[3], h[5], h[4] - h[3], h[1])):
            if kept and h[3] - kept[-1][3] <= 2 * k:
                if h[3] == kept[-1][3] or (h[5], h[4] - h[3]) >= (kept[-1][5], kept[-1][4] - kept[-1][3]):
                    continue
                kept.pop()
            kept.append(h)
        out += kept
    return Counter(out)


@pytest.fixture(scope="module")
def random_case():
    rng = random.Random(11)
    refs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 9, 300, 700)] + ["ACGT" * 70, ""]
    reads = [(f"r{n}", "".join(rng.choice("ACGT") for _ in range(n))) for n in (1, 2, 3, 8, 20)]
    for n in range(12):
        t = refs[rng.choice([3, 4, 5])]
        b = rng.randrange(len(t) - 30)
        p = list(t[b : b + rng.randrange(12, 30)])
        for _ in range(rng.randrange(4)):
            x = rng.randrange(len(p))
            p[x : x + 1] = rng.choice([["A"], [], ["C", p[x]], ["N"]])
        reads.append((f"m{n}", rc("".join(p)) if n % 3 == 0 else "".join(p)))
    return [*reads, ("empty", "")], refs


@pytest.fixture(params=["scan", "join"])
def path(request, monkeypatch):
    """Few reads in one pass, in pieces of few letters; or as if they were many."""
    if request.param == "join":
        monkeypatch.setattr(scan, "MOST_LETTERS", -1)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_hamming_is_brute_force(spark, random_case, k, path):
    reads, refs = frames(spark, *random_case)
    got = Counter(map(tuple, matching.hamming_match(reads, refs, k).select(*HIT).collect()))
    assert got == Counter(hamming_brute(*random_case, k))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_is_brute_force(spark, random_case, k, path):
    reads = [r for r in random_case[0] if len(r[1]) > 3]
    frames_ = frames(spark, reads, random_case[1])
    want = starts_brute(reads, random_case[1], k)
    assert Counter(map(tuple, matching.edit_starts(*frames_, k).select(*HIT).collect())) == Counter(want)
    assert Counter(map(tuple, matching.edit_match(*frames_, k).select(*HIT).collect())) == thin_brute(want, k)


@pytest.mark.parametrize("k", [1, 2, 7, 13])
def test_packed_kmers(k):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGTN") for _ in range(60))
    got = scan.packed(np.frombuffer(text.encode(), np.uint8), k).tolist()
    assert got == [sum("ACGTN".index(c) * 5**i for i, c in enumerate(text[a : a + k])) for a in range(60 - k + 1)]


def test_pieces_join_up(random_case):
    """A sequence cut into small pieces gives what it gives whole."""
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(500))
    reads = [(f"r{n}", text[20 * n : 20 * n + 12 + n]) for n in range(20)]
    patterns = scan.Patterns(reads, 1)
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], names=["seq_idx", "seq"])

    class shared:
        value = patterns

    def hits(metric, size):
        old, scan.PIECE = scan.PIECE, size
        try:
            return Counter(tuple(r.values()) for b in scan._match(scan._cut([batch], 40, 40), shared, 1, metric) for r in b.to_pylist())
        finally:
            scan.PIECE = old

    for metric in ("hamming", "edit"):
        assert hits(metric, 37) == hits(metric, 1 << 16) and hits(metric, 37)


def test_memory_does_not_grow_with_the_batch(monkeypatch):
    """Short reads of two letters stand nearly everywhere; groups of candidates of any size give the same hits."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("AT") for _ in range(6000)) for _ in range(64)]
    reads = [(f"r{n}", "".join(rng.choice("ACGT"[:: 1 if n % 4 else 3]) for _ in range(12 + n))) for n in range(12)]

    class shared:
        value = scan.Patterns(reads, 2)

    def batch(some):
        cut = list(scan._cut([pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], names=["seq_idx", "seq"])], 30, 30))
        return pa.Table.from_batches(cut).combine_chunks().to_batches()

    def hits(some):
        return Counter(tuple(r.values()) for b in scan._match(batch(some), shared, 2, "edit") for r in b.to_pylist())

    whole = hits(texts[:2])
    monkeypatch.setattr(scan, "SEARCHED", 1 << 14)
    monkeypatch.setattr(scan, "CANDIDATES", 1 << 12)
    assert hits(texts[:2]) == whole and whole
    peaks = []
    for n in (8, 64):
        tracemalloc.start()
        sum(b.num_rows for b in scan._match(batch(texts[:n]), shared, 2, "edit"))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_thinning_goes_on_over_batches(size):
    rng = random.Random(size)
    rows = {(f"r{rng.randrange(3)}", rng.choice(["FW", "RC"]), rng.randrange(3), rng.randrange(120)): (rng.randrange(3), rng.randrange(8, 13)) for _ in range(400)}
    rows = sorted(((*key, key[3] + w, d) for key, (d, w) in rows.items()), key=lambda h: (h[0], h[2], h[3], h[5], h[4] - h[3], h[1]))
    batches = pa.Table.from_pylist([dict(zip(HIT, r)) for r in rows]).to_batches(max_chunksize=size)
    got = Counter(tuple(r.values()) for b in matching._thin(iter(batches), 4) for r in b.to_pylist())
    assert got == thin_brute(rows, 2)


def test_palindromes_records_and_letters(spark):
    reads, refs = frames(spark, [("p", "ACGT"), ("b", "CCGG"), ("n", "ACNT")], ["TTACGTTT", "AAACC", "GGTTT"])
    assert sorted(map(tuple, matching.exact_match(reads, refs).select(*HIT).collect())) == [("p", "FW", 0, 2, 6, 0), ("p", "RC", 0, 2, 6, 0)]
    one = matching.hamming_match(reads, refs, 1).where("read_id = 'p' and distance = 0").collect()
    assert [tuple(r) for r in one] == [("p", "FW", 0, 2, 6, 0)]


def test_every_strategy_and_mode(spark, random_case):
    reads, refs = frames(spark, *random_case)
    all_hits = set(map(tuple, map_reads(reads, refs, MapConfig(metric="hamming", k=2)).select(*HIT).collect()))
    for strategy in ("kuch1", "pigeon", "minU"):
        assert set(map(tuple, map_reads(reads, refs, MapConfig(metric="hamming", k=2, strategy=strategy)).select(*HIT).collect())) == all_hits
    least = {}
    for h in all_hits:
        least[h[0]] = min(least.get(h[0], 9), h[5])
    got = set(map(tuple, map_reads(reads, refs, MapConfig(metric="hamming", k=2, mode="best+1")).select(*HIT).collect()))
    assert got == {h for h in all_hits if h[5] <= least[h[0]] + 1}


@pytest.mark.parametrize("wrong", [{"metric": "x"}, {"k": 14}, {"strategy": "kuch1", "k": 5}, {"strategy": "custom"}, {"mode": "worst"}, {"identity": 40}])
def test_wrong_options_are_refused(wrong):
    with pytest.raises(ValueError):
        MapConfig(**wrong)


def test_mapq(spark):
    hits = spark.createDataFrame([(f"r{n}", "FW", 0, i, i + 4, 1) for n in (1, 2, 3, 4, 10) for i in range(n)] + [("r1", "FW", 0, 50, 54, 2)], "read_id string, strand string, seq_idx long, begin long, end long, distance long")
    got = {(r.read_id, r.is_best): r.mapq for r in reporting.ranked(hits).collect()}
    assert got == {("r1", True): 60, ("r1", False): 0, ("r2", True): 3, ("r3", True): 2, ("r4", True): 1, ("r10", True): 0}


def test_empty(spark):
    reads, refs = frames(spark, [], [])
    for k in (0, 1):
        assert matching.hamming_match(reads, refs, k).count() == 0 and matching.edit_match(reads, refs, k).count() == 0
