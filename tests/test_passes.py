"""How often the references are read: letters by a mask, places of all strategies at once, files parsed once, pieces cut once for all rounds."""

from pyspark.sql import functions as F

from strandwise import catalog
from strandwise.functions import sequence
from strandwise.operators import intervals, scan, searching
from strandwise.sources import sequences
from test_matching import frames

SF = "/root/testdata/sf0.001"


def test_letters_by_a_mask_are_those_of_the_expression(spark):
    texts = [None, "", "acgtACGT", "aéc ÀGTñ…t\x00T", "xyz", None, "gaİſﬀ𝒜cA\n", "N" * 5000 + "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    want = [tuple(r) for r in rows.select("i", sequence.keep_acgt(F.col("t"))).collect()]
    assert [tuple(r) for r in sequence.with_acgt(rows, "t").collect()] == want
    assert [tuple(r) for r in sequence.with_acgt(rows.where("i > 1"), "t").collect()] == want[2:]
    assert "regexp_replace" not in catalog.ref_seqs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_all_strategies_are_counted_in_one_pass(spark):
    reads, refs = [("a", "ACGTACGTAC"), ("n", "ACGNACGTAA")], ["ACGTACGTACGG", "ACG", "NACGTACC", ""]
    r, f = frames(spark, reads, refs)
    pieces = scan.pieces(f, 0, scan.LONGEST_SEED)
    choices = [searching.scheme_seeds(s, 1) for s in ("kuch1", "pigeon")] + [None]
    want = []
    for seeds in choices:
        own = scan.Patterns(reads, 1, seeds)
        found = [x for t in own.texts for x in (seeds or scan.even_seeds)(t, 1)]
        want.append(sum(t.startswith(x.tobytes().decode(), b) for x, *_ in found for t in refs for b in range(len(t))))
    # letters but ACGT are one letter, and here only N
    assert scan.count_places_of_each(pieces, reads, 1, choices) == want
    assert [scan.count_places(pieces, reads, 1, s) for s in choices] == want
    jobs = []
    for names in (("kuch1",), ("kuch1", "pigeon", "kianfar")):
        spark.sparkContext.setJobGroup(f"costs-{len(names)}", "")
        searching.strategy_costs(r, pieces, 1, names)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"costs-{len(names)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_fasta_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x y\nACG\nT\n>e\n>z\nGG\n")
    found = sequences.read_reference_fasta(spark, str(tmp_path / "a.fasta"), range_bytes=4)
    assert "BatchScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, "x", "ACGT", 4), (1, "e", "", 0), (2, "z", "GG", 2)]


def test_lengths_are_taken_once_for_offsets(spark):
    offsets = intervals.sequence_offsets(catalog.ref_seqs(spark, SF))
    assert "MapInArrow" not in offsets._jdf.queryExecution().executedPlan().toString()


def test_pieces_are_cut_once_for_all_rounds(spark, monkeypatch):
    cuts, pieces = [], scan.pieces
    monkeypatch.setattr(scan, "pieces", lambda *a: cuts.append(a) or pieces(*a))
    catalog.QUERIES["best_plus_x"](spark, SF)
    assert len(cuts) == 1
