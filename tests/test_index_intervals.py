"""The persisted index, interval joins, trimming, phi by intervals, the suffix array of one long text and rounds, against brute force."""

import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import bwt, growing, intervals, long_text, matching, scan, schemes, searching, seed_index
from strandwise.plans.mapping import MapConfig, map_reads
from strandwise.sources.storage import new_path, qualified
from test_matching import HIT, edit_distance, frames, hamming_brute, rc, starts_brute, strands, thin_brute


def case(seed, reads=14, refs=7):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = text(60)
    seqs = [text(rng.randrange(20, 300)) + shared[: rng.randrange(60)] + text(40) for _ in range(refs)] + ["", "AC"]
    own = [(f"r{i}", s[b : b + rng.choice((5, 9, 14, 30))]) for i, s in enumerate(rng.choice(seqs[:refs]) for _ in range(reads)) for b in [rng.randrange(len(s) - 30)]]
    own += [("n", "ACGNT"), ("e", ""), ("rc", rc(own[3][1]))]
    return own, seqs


def rows(df):
    return [tuple(r[c] for c in HIT) for r in df.collect()]


@pytest.fixture(scope="module")
def indexed(spark):
    reads, refs = case(1)
    r, f = frames(spark, reads, refs)
    path = qualified(spark, new_path(spark, "test-index"))
    seed_index.build(f, path, seed=5, flank=64, buckets=4)
    return reads, refs, r, seed_index.load(spark.newSession(), path), path


@pytest.mark.parametrize("most", [0, None])
@pytest.mark.parametrize("k", [0, 1, 2])
def test_mapping_from_the_index_is_brute_force(indexed, k, most):
    reads, refs, r, index, _ = indexed
    got = rows(seed_index.match(r, index, k, "hamming", most_letters=most))
    want = hamming_brute(reads, refs, k)
    if k == 0:
        want = {(i, s, j, b, b + len(p), 0) for (i, s, p), (j, t) in itertools.product(strands(reads), enumerate(refs)) for b in range(len(t) - len(p) + 1) if t[b : b + len(p)] == p}
    assert sorted(got) == sorted(want)
    if k:
        got = rows(seed_index.match(r, index, k, "edit", most_letters=most))
        assert sorted(got) == sorted(thin_brute(starts_brute(reads, refs, k), k))


def exchanges_over(plan: str, table: str) -> int:
    """Exchanges between a scan of the table and the first join above it."""
    lines = plan.split("\n")
    at = next(n for n, x in enumerate(lines) if "FileScan" in x and table in x)
    depth = lambda x: re.search(r"[A-Za-z*]", x.replace(":", " ").replace("+-", "  ")).start()
    found, level = 0, depth(lines[at])
    for x in lines[at - 1 :: -1]:
        if "Join" in x and depth(x) < level:
            return found
        if depth(x) < level:
            found, level = found + ("Exchange" in x), depth(x)
    return found


def test_no_reference_is_shuffled_at_mapping(indexed):
    _, _, r, index, path = indexed
    joined = seed_index._joined(r, index, 1, "hamming")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "kmers" in plan and "tiles" in plan
    for table in (f"{path}/kmers", f"{path}/tiles"):
        assert exchanges_over(plan, seed_index._table_name(path, table.rsplit("/", 1)[1])) == 0
    assert plan.count("Bucketed: true") >= 2
    scanned = seed_index.match(r, index, 0, "hamming")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in scanned


def test_reads_beyond_the_flank_and_other_versions_are_refused(indexed, spark):
    *_, index, path = indexed
    long = spark.createDataFrame([("x", "ACGT" * 30)], "read_id string, seq string")
    with pytest.raises(ValueError, match="flank"):
        seed_index.match(long, index, 1)
    other = new_path(spark, "test-index")
    spark.createDataFrame([('{"tag": 1}',)], "value string").coalesce(1).write.text(f"{other}/meta")
    with pytest.raises(ValueError, match="version"):
        seed_index.load(spark, other)


def test_candidates_stand_where_whole_parts_do(indexed):
    """Not wherever a part's first letters stand: those are most of the references' places."""
    reads, refs, r, index, _ = indexed
    own = r.where(F.length("seq").between(index.seed, index.seed + seed_index.AHEAD))
    found = {tuple(c) for c in seed_index.candidates(own, index, 0).select("read_id", "strand", "seq_idx", "begin").collect()}
    want = {(i, s, j, b) for (i, s, p), (j, t) in itertools.product(strands(reads), enumerate(refs)) for b in range(len(t)) if index.seed <= len(p) <= index.seed + seed_index.AHEAD and t[b : b + len(p)] == p}
    assert found == want


def test_a_frequent_kmer_is_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(seed_index, "PART_PLACES", 2000)
    monkeypatch.setattr(seed_index, "BUCKET_LETTERS", 4000)
    r, f = frames(spark, [("a", "A" * 20), ("c", "AAAAAC"), ("t", "TTTTTT")], ["A" * 9000 + "C", "A" * 9000])
    index = seed_index.build(f, new_path(spark, "test-index"), seed=5, flank=64)
    assert index.parts == 9 and index.buckets >= 5
    most = index.kmers.groupBy("kmer", "part").count().agg(F.max("count")).first()[0]
    assert most < 18000 / 2
    got = seed_index.match(r, index, 0, "hamming", most_letters=0).groupBy("read_id", "strand").count().collect()
    assert {tuple(x) for x in got} == {("a", "FW", 2 * 8981), ("c", "FW", 1), ("t", "RC", 2 * 8995)}


def test_a_relative_path_is_the_same_place(spark, tmp_path):
    r, f = frames(spark, [("a", "GATTACA")], ["TTGATTACATT"])
    relative = os.path.relpath(tmp_path / "index")
    seed_index.build(f, relative, seed=3, flank=16, buckets=2)
    index = seed_index.load(spark.newSession(), str(tmp_path / "index"))
    assert rows(seed_index.match(r, index, 0, "hamming", most_letters=0)) == [("a", "FW", 0, 2, 9, 0)]


def test_empty_index_and_no_reads(spark):
    r, f = frames(spark, [], [])
    index = seed_index.build(f, new_path(spark, "test-index"), seed=5, flank=64, buckets=2)
    some, _ = frames(spark, [("a", "ACGTAC")], [])
    for own in (r, some):
        for most in (0, None):
            assert seed_index.match(own, index, 1, "edit", most_letters=most).count() == 0


@pytest.mark.parametrize("metric", ["edit", "hamming"])
@pytest.mark.parametrize("beyond", [0, 1])
def test_rounds_equal_one_search(indexed, spark, metric, beyond):
    reads, refs, r, index, _ = indexed
    _, f = frames(spark, reads, refs)
    seen = []

    def find(own, k):
        seen.append((k, own.count()))
        return matching.found(own, f, k, metric)

    got = rows(matching.best_match(r, 3, beyond, metric, find))
    full = thin_brute(starts_brute(reads, refs, 3), 3) if metric == "edit" else hamming_brute(reads, refs, 3)
    best = {}
    for i, *_, d in full:
        best[i] = min(best.get(i, d), d)
    want = [h for h in full if h[-1] <= best[h[0]] + beyond]
    assert sorted(got) == sorted(want)
    assert [n for _, n in seen] == sorted((n for _, n in seen), reverse=True) and seen[-1][1] < seen[0][1]
    mode = f"best+{beyond}" if beyond else "best"
    for target in (f, index):
        assert sorted(rows(map_reads(r, target, MapConfig(metric=metric, k=3, mode=mode)))) == sorted(want)


def test_running_sums(spark):
    rng = random.Random(2)
    data = [(i * i - 900, rng.randrange(50)) for i in range(700)]
    want, total = {}, 0
    for i, n in sorted(data):
        want[i], total = total, total + n
    df = spark.createDataFrame(data, "id long, n long").repartition(5)
    assert {r.id: r.before for r in intervals.running_sum(df, "id", "n", "before").collect()} == want
    assert intervals.running_sum(df.where("false"), "id", "n", "before").count() == 0


def test_points_meet_their_interval(spark):
    rng = random.Random(3)
    starts, at = [], 0
    for g in range(2):
        at = 0
        for _ in range(60):
            size = rng.choice((0, 1, 3, 50, 5000))
            starts.append((g, at, at + size))
            at += size + rng.randrange(3)
    points = [(g, rng.randrange(at + 9)) for g in range(2) for _ in range(400)] + [(0, starts[40][1])] * 300
    got = intervals.within(spark.createDataFrame(points, "g int, p long"), F.col("p"), spark.createDataFrame(starts, "g int, lo long, hi long"), "lo", "hi", by=("g",))
    want = [(g, p, lo, hi) for g, p in points for h, lo, hi in starts if g == h and lo <= p < hi]
    assert sorted((r.g, r.p, r.lo, r.hi) for r in got.collect()) == sorted(want)


def trim_brute(reads, refs, k, cost, metric):
    text = "".join(refs)
    own = [(i, sum(map(len, refs[:i])), sum(map(len, refs[: i + 1]))) for i, s in enumerate(refs) if s]
    out = set()
    for i, s, p in strands(reads):
        for b in range(len(text)):
            if metric == "hamming":
                w = text[b : b + len(p)]
                found = (sum(x != y for x, y in zip(p, w)) if len(w) == len(p) else k + 1, b + len(p))
            else:
                found = min(((edit_distance(p, text[b:e]), e) for e in range(max(b + 1, b + len(p) - k), min(len(text), b + len(p) + k) + 1)), default=(k + 1, 0))
            d, e = found
            if d > k:
                continue
            n = next(n for n, (_, lo, hi) in enumerate(own) if lo <= b < hi)
            j, lo, hi = own[n]
            if e <= hi:
                out.add((i, s, j, b - lo, e - lo, d, False))
                continue
            if metric == "hamming":
                continue
            if hi - b <= k:
                j, lo, end = own[n + 1]
                f, t = lo, min(e, end)
            elif e - hi <= k:
                f, t = b, hi
            else:
                continue
            lost = (e - b) - (t - f) if cost else 0
            if t > f and d + lost <= k:
                out.add((i, s, j, f - lo, t - lo, d + lost, True))
    return out


@pytest.mark.parametrize("k, cost, metric", [(1, True, "edit"), (2, False, "edit"), (2, True, "edit"), (1, True, "hamming")])
def test_trimming_is_brute_force(spark, k, cost, metric):
    rng = random.Random(5)
    refs = ["".join(rng.choice("ACG") for _ in range(rng.choice((0, 1, 2, 7, 40, 90)))) for _ in range(24)]
    text = "".join(refs)
    ends = [n for n in itertools.accumulate(map(len, refs)) if 10 < n < len(text) - 9]
    reads = [(f"r{n}", text[b : b + 11]) for n, b in enumerate([*range(0, len(text) - 11, 60), *(e - 10 for e in ends[::3]), *(e - 1 for e in ends[1::3])])]
    r, f = frames(spark, reads, refs)
    got = intervals.trimmed_match(r, f, k, metric=metric, trim_cost=cost, piece=64).collect()
    want = trim_brute(reads, refs, k, cost, metric)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert metric == "hamming" or any(x[-1] for x in want)


def suffixes(text):
    return sorted(range(len(text) + 1), key=lambda i: text[i:] + "$")


@pytest.mark.parametrize("texts", [["ACGT" * 60, "ACGT" * 60, "", "GATTACA"], ["A" * 500], ["".join(random.Random(7).choice("ACGT") for _ in range(900)) * 2, "C"], [], ["T"]])
def test_long_suffix_array(spark, texts):
    _, f = frames(spark, [], texts)
    offsets = intervals.sequence_offsets(f)
    pieces = intervals.text_of_all(f, offsets, long_text.FIRST, 128)
    got = {r.i: r.sa for r in long_text.suffix_array(pieces, sum(map(len, texts))).collect()}
    assert [got[i] for i in range(len(got))] == suffixes("".join(texts))


def test_leading_letters():
    letters = np.frombuffer(b"ACGTTGCAAC", np.uint8)
    for k in (1, 2, 5, 9, 27):
        want = [int("".join(str(" ACGT".index(c)) for c in "ACGTTGCAAC"[i : i + k]).ljust(k, "0"), 5) for i in range(10)]
        assert long_text.leading(letters, k).tolist() == want


def test_phi_by_intervals(spark):
    texts = [(1, "ACGACGACGTACG" * 2), (2, "AAAAAAAAAA"), (3, "T"), (4, "")]
    t = spark.createDataFrame(texts, "text_id long, text string")
    sa = bwt.suffix_array(t)
    runs = bwt.runs(bwt.bwt(sa))
    steps = intervals.phi_intervals(runs)
    found = {(r.text_id, r.input, r.upto): r.output for r in steps.collect()}
    for r in bwt.phi(sa).collect():
        (lo, out), = [(lo, out) for (i, lo, hi), out in found.items() if i == r.text_id and lo <= r.sa < hi]
        assert out + r.sa - lo == r.phi
    assert len(found) == runs.count()
    patterns = t.where("length(text) >= 3").select("text_id", F.explode(F.expr("transform(sequence(1, length(text) - 2), i -> substring(text, i, 3))")).alias("pattern")).distinct()
    ranges = bwt.backward_search(bwt.bwt(sa), patterns, 3)
    got = intervals.locate_by_phi(bwt.toeholds(ranges, sa), steps, bwt.plcp(t, sa), 3)
    want = [(i, x[p : p + 3], p) for i, x in texts for p in range(len(x) - 2)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_common_extensions():
    rng = random.Random(9)
    text = "".join(rng.choice("AC") for _ in range(300)) + "A" * 200
    a, b = np.array([rng.randrange(501) for _ in range(400)]), np.array([rng.randrange(501) for _ in range(400)])

    def same(i, j):
        n = 0
        while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n

    assert bwt.common_extensions(text.encode(), a, b).tolist() == [same(i, j) for i, j in zip(a.tolist(), b.tolist())]
    assert bwt.common_extensions(b"", np.array([0]), np.array([0])).tolist() == [0]


def test_parts_grow_by_selectivity():
    counts = np.zeros(5**3, np.int64)
    number = lambda s: int(scan.packed(np.frombuffer(s, np.uint8), 3)[0])
    counts[number(b"AAA")], counts[number(b"AAC")], counts[number(b"CCC")] = 100, 7, 1
    text = np.frombuffer(b"AAAAAAAACCCGTGTGT", np.uint8)
    parts = growing.grown_parts(text, 3, counts, 3)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and all(b - a >= 3 for a, b in parts)
    assert parts[0][1] > 5  # the frequent letters are in as few parts as may be
    assert growing.grown_parts(text[:8], 3, counts, 3) == [(0, 2), (2, 5), (5, 8)]
    assert growing.rarest_seed(text, 0, 17, counts, 3) == 1 or counts[scan.packed(text, 3)][growing.rarest_seed(text, 0, 17, counts, 3) :].min() == 0


@pytest.mark.parametrize("k", [1, 2])
def test_grown_parts_find_the_same_with_fewer_candidates(spark, k):
    rng = random.Random(12)
    refs = ["".join(rng.choice("AAAAAAAT") for _ in range(400)) + "".join(rng.choice("ACGT") for _ in range(150)) for _ in range(8)]
    reads = [(f"r{i}", refs[i % 8][b : b + 33]) for i, b in enumerate(rng.randrange(360, 420) for _ in range(24))]
    r, f = frames(spark, reads, refs)
    pieces = scan.pieces(f, 40, 40).persist()
    assert sorted(rows(growing.match(r, pieces, k, "hamming", length=4))) == sorted(hamming_brute(reads, refs, k))
    full = matching.edit_match(r, f, k)
    assert sorted(rows(growing.match(r, pieces, k, "edit", length=4))) == sorted(rows(full))
    counts = growing.window_counts(pieces, 4)
    even, grown = (scan.count_places(pieces, reads, k, p) for p in (None, growing.seeds_by_count(counts, 4)))
    assert 0 < grown < even
    pieces.unpersist()


@pytest.mark.parametrize("strategy, k", [("minU", 6), ("kuch1", 4), ("01*0", 2), ("kianfar", 4), ("pigeon", 1)])
def test_schemes_that_run_are_brute_force(spark, strategy, k):
    reads, refs = case(4, reads=10, refs=4)
    reads += [("long", refs[0][3:60]), ("other", rc(refs[1][10:70]))]
    r, f = frames(spark, reads, refs)
    got = rows(searching.match(r, scan.pieces(f, 80, 80), k, strategy))
    assert sorted(got) == sorted(hamming_brute(reads, refs, k))


def test_stretches_and_neighbours():
    for strategy in ("kuch1", "kuch2", "kianfar", "01*0", "pigeon", "minU"):
        for k in range(1, 5):
            for lo, hi, errors in searching.stretches(schemes.build(strategy, k)):
                assert lo <= hi and errors <= searching.UTMOST_ERRORS
    letters = np.frombuffer(b"ACGTA", np.uint8)
    found = {bytes(x) for x in searching.neighbours(letters, 2)}
    assert len(found) == 1 + 15 + 90 == len(searching.neighbours(letters, 2))
    with pytest.raises(ValueError, match="first part"):
        searching.stretches(schemes.build("naive", 3))


def test_counters(indexed, spark):
    reads, refs, r, index, _ = indexed
    counters = scan.Counters(spark)
    hits = map_reads(r, index, MapConfig(metric="hamming", k=1), counters)
    assert counters.values() == {"places": 0, "candidates": 0, "verified": 0, "dropped": 0}
    hits.write.format("noop").mode("overwrite").save()
    found = counters.values()
    both = sum(sum(x != y for x, y in zip(p, t[b:])) <= 1 for (_, _, p), t in itertools.product(strands(reads), refs) for b in range(len(t) - len(p) + 1))
    assert found["verified"] == both and found["places"] >= found["candidates"] > both and found["dropped"] == found["candidates"] - both
