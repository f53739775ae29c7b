"""Operator 11: held-out accuracy, bounds of the sample, and rows without labels."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandwise.llm import compression_quality as cq
from strandwise.llm import queries

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op11_compression_quality(spark, SF).collect()}
    texts = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(got) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    same = {}
    for d in texts:
        assert same.setdefault(d["text"], got[d["doc_id"]].score) == got[d["doc_id"]].score
    known = [(r["quality"], got[r["doc_id"]]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if got[r["doc_id"]].held_out]
    good, bad = ([r.score for q, r in known if q == label] for label in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(bad) >= 5 and auc > 0.9 and np.mean([r.predicted for q, r in known if q]) > 0.95


def test_held_out_labels_do_not_matter_and_reruns_agree(make_docs, spark):
    rows = [(i, ("plain words in a row %d " % i) * 5 if i % 3 else "### $$$ %%% &&& " * (5 + i % 7)) for i in range(300)]
    own = [(i, int(i % 3 > 0), 0) for i in range(300)]
    turned = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, 0) for i, q, _ in own]
    a, b = (cq.fitted(make_docs(rows), labels(spark, x)) for x in (own, turned))
    assert a == b and a.bad
    got = {r.doc_id: r for r in cq.quality_scores(make_docs(rows), a).collect()}
    assert np.mean([got[i].predicted == q for i, q, _ in own]) > 0.97


def test_the_sample_is_bounded_and_leaves_out_contradictions(make_docs, spark):
    rows = [(i, "x" * 100) for i in range(400)] + [(5, "x" * 100), (None, "y"), (401, None), (402, "")]
    own = [(i, i % 2, 0) for i in range(400)] + [(7, 0, 0), (7, 1, 0), (None, 1, 0), (8, None, 0), (401, 1, 0), (402, 1, 0), (999, 1, 0)]
    sample = cq.training_sample(make_docs(rows), labels(spark, own), rows=50, size=2000)
    assert len(sample) <= 40 and {q for q, _ in sample} == {0, 1}
    everything = cq.training_sample(make_docs(rows), labels(spark, own))
    assert len(everything) == sum(zlib.crc32(str(i).encode()) % 5 > 0 and i != 7 for i in range(400))


@pytest.mark.parametrize("own", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0), (2, 1, 0), (3, 0, 0), (4, 1, 0), (6, 1, 0), (8, 0, 0)]])
def test_few_labels_and_odd_rows(make_docs, odd_texts, spark, own):
    docs = make_docs(odd_texts)
    got = cq.quality_scores(docs, cq.fitted(docs, labels(spark, own))).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] and scores[8] == scores[9]


def test_long_texts_are_read_whole():
    rng = np.random.default_rng(2)
    words = {letters: ["".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(300)] for letters in ("#$%&", "abcdef")}
    make = lambda letters, n: " ".join(rng.choice(words[letters], n)) + " "
    bad, good = make("#$%&", 3000).encode(), make("abcdef", 3000).encode()
    text = make("abcdef", 60_000)
    assert cq.differences([text + make("#$%&", 300_000)], bad, good)[0] < 0 < cq.differences([text], bad, good)[0]


def test_empty(make_docs, spark):
    empty = make_docs([])
    assert cq.quality_scores(empty, cq.fitted(empty, labels(spark, []))).count() == 0


def test_rising_shares():
    at, share = cq.rising_shares(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 0, 1, 0, 1, 1]))
    assert list(at) == sorted(at) and len(at) < 6 and share[0] < 0.5 < share[-1]
