"""The stages of corpus_pipeline.py, each against brute force on its own input, and the whole of it."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from test_line_dedup import brute as brute_lines
from test_mixing import targets
from test_ngram_join import components
from test_quality import brute as brute_quality

from strandwise.llm import quality
from strandwise.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_names_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert tuple(docs.columns) == corpus_pipeline.COLUMNS


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, f in corpus_pipeline.STAGES:
        tables.append(stage(f(spark, tables[-1], SF), name))
        if name != "packing":
            assert tables[-1].columns == docs.columns and tables[-1].dtypes == docs.dtypes
    rows = [t.collect() for t in tables]
    start, clean, lines, single, mixed, packed = rows
    assert clean and lines and single and mixed and packed

    kept = {r[0] for r in brute_quality([(r.doc_id, r.text, r.source) for r in start], quality.MIN_DOCUMENTS, quality.SHARE) if r[-1]}
    assert {r.doc_id for r in clean} == kept and len(clean) == len(kept)
    assert all(r.n_chars == len(r.text) for r in clean)

    want = brute_lines([(r.doc_id, r.text) for r in clean])
    assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in lines) == Counter((i, h) for i, _, _, h in want.elements())

    want = components([(r.doc_id, r.text) for r in lines], 5, 8, 10)
    assert Counter(r.doc_id for r in single) == Counter(i for i, n, c in want if not n or i == c)
    texts = {r.doc_id: r.text for r in lines}
    assert all(texts[r.doc_id] == r.text for r in single)

    sizes, taken, largest, words = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in single:
        words[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sizes[r.source] += words[r.doc_id]
        largest[r.source] = max(largest[r.source], words[r.doc_id])
    for r in mixed:
        taken[r.source] += words[r.doc_id]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    for s, t in targets(sizes).items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_run_and_empty(spark, make_docs):
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = make_docs([], extra=False)
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, empty, SF).count() == 0
