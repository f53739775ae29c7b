"""Sources, sinks, schemes, suffix-array views, the command line and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from strandwise.__main__ import main
from strandwise.functions import sequence
from strandwise.operators import bwt, matching, schemes
from strandwise.plans import mapping
from strandwise.sources import sequences
from strandwise.streaming.mapping import map_stream


def test_columns(spark):
    df = spark.createDataFrame([("acgtn", "ACGTN"), ("ACGßT", "ACG"), (None, "TT")], "a string, b string")
    rows = df.select(sequence.mask_ambiguous(F.col("a")), sequence.revcomp(F.col("b")), sequence.pack_kmer(F.col("b")), sequence.unpack_kmer(sequence.pack_kmer(F.col("b")), 3)).collect()
    assert [tuple(r) for r in rows] == [("ACGTN", "NACGT", None, None), ("ACGNT", "CGT", 6, "ACG"), (None, "AA", 15, "ATT")]


def test_ambiguous_letters_are_filled(spark):
    df = spark.createDataFrame([("acNNNgNN",), ("NNNNNN",), ("",), (None,)], "seq string")
    seed = sequence.replacement_seed(4)
    got = [r.seq for r in sequence.fill_ambiguous(df, "seq", 4).collect()]
    assert got == ["AC" + seed[:3] + "G" + seed[:2], seed + seed[:2], "", None]
    drawn = [r.seq for r in sequence.fill_ambiguous(df, "seq", 0).collect()]
    assert [len(x or "") for x in drawn] == [8, 6, 0, 0] and not set("".join(x or "" for x in drawn)) - set("ACGT")


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one first\nACGT\nac\r\n>two\n\n>three x\nGG\n")
    refs = sequences.read_reference_fasta(spark, str(tmp_path / "r.fa")).orderBy("seq_idx").collect()
    assert [tuple(r) for r in refs] == [(0, "one", "ACGTAC", 6), (1, "two", "", 0), (2, "three", "GG", 2)]
    (tmp_path / "q.fastq").write_text("".join(f"@r{i} x\nacg{'n' * (i % 3)}t\n+\n@III\n" for i in range(500)))
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    reads = {r.read_id: (r.seq, r.qual) for r in sequences.read_reads(spark, str(tmp_path / "q.fastq")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", conf)
    assert reads == {f"r{i} x": ("ACG" + "N" * (i % 3) + "T", "@III") for i in range(500)}
    assert {r.read_id for r in sequences.read_reads(spark, str(tmp_path / "r.fa")).collect()} == {"one", "two", "three"}
    (tmp_path / "bad.fq").write_text("r1\nA\n+\nI\n")
    with pytest.raises(Exception, match="FASTQ"):
        sequences.read_reads(spark, str(tmp_path / "bad.fq")).collect()
    with pytest.raises(ValueError):
        sequences.read_reads(spark, "x.bam")


def test_command_line(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(">a\nTTACGTTTGGCA\n>b\nCCCCGGGGAAAA\n")
    (tmp_path / "reads.fq").write_text("@x\nACGTTT\n+\nABCDEF\n@y\nTTTTCCCC\n+\n12345678\n@z\nGATTACAGATTACA\n+\n##############\n")
    main(["build", str(tmp_path / "ref"), str(tmp_path / "index")])
    main(["map", "-r", str(tmp_path / "index"), "-f", str(tmp_path / "reads.fq"), "-o", str(tmp_path / "out.sam"), "-e", "1", "-m", "hamming"])
    lines = [r.value for r in sorted(spark.read.text(str(tmp_path / "out.sam")).withColumn("n", F.monotonically_increasing_id()).collect(), key=lambda r: r.n)]
    assert lines[0].startswith("@HD") and [x for x in lines if x.startswith("@SQ")] == ["@SQ\tSN:a\tLN:12", "@SQ\tSN:b\tLN:12"]
    assert "x\t0\ta\t3\t60\t*\t*\t0\t0\tACGTTT\tABCDEF\tAS:i:0\tNM:i:0\tPG:Z:strandwise" in lines
    assert "y\t16\tb\t5\t60\t*\t*\t0\t0\tGGGGAAAA\t87654321\tAS:i:0\tNM:i:0\tPG:Z:strandwise" in lines
    assert "z\t4\t*\t0\t0\t*\t*\t0\t0\tGATTACAGATTACA\t##############\tPG:Z:strandwise" in lines
    main(["map", "-r", str(tmp_path / "index"), "-f", str(tmp_path / "reads.fq"), "-o", str(tmp_path / "out.rhs")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out.rhs")).collect()) == ["x\t(a,0)", "y\t(b,0)", "z\t*"]
    (tmp_path / "turned.fq").write_text("@z\nGATTACAGATTACA\n+\n##############\n@x\nACGTTT\n+\nABCDEF\n@y\nTTTTCCCC\n+\n12345678\n")
    for name in ("turned.sam", "turned.rhs"):
        main(["map", "-r", str(tmp_path / "index"), "-f", str(tmp_path / "turned.fq"), "-o", str(tmp_path / name)])
        lines = [r.value for r in sorted(spark.read.text(str(tmp_path / name)).withColumn("n", F.monotonically_increasing_id()).collect(), key=lambda r: r.n)]
        assert [x.split("\t")[0] for x in lines if x[0] != "@"] == ["z", "x", "y"]  # in input order
    (tmp_path / "own" / "1").mkdir(parents=True)
    (tmp_path / "own" / "name.txt").write_text("own")
    (tmp_path / "own" / "1" / "searches.txt").write_text(schemes.KIANFAR[1])
    (tmp_path / "two.fq").write_text("@x\nCCCC\n+\nABCD\n@z\nGATTACAG\n+\n########\n")
    many = ["map", "-r", str(tmp_path / "index"), "-f", str(tmp_path / "two.fq"), "-m", "hamming", "-c", str(tmp_path / "own"), "-T", "-o", str(tmp_path / "xa.sam")]
    main([*many, "-e", "1"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "xa.sam")).collect() if not r.value.startswith("@")]
    # best: CCCC forward at 1, GGGG reversed at 5; one error: forward at 2, reversed at 4 and 6
    assert sorted(lines) == ["x\t0\tb\t1\t3\t*\t*\t0\t0\tCCCC\tABCD\tAS:i:0\tNM:i:0\tPG:Z:strandwise\tX0:i:1\tX1:i:3\tXA:Z:b,-5,*,0;b,+2,*,1;b,-4,*,1;b,-6,*,1;", "z\t4\t*\t0\t0\t*\t*\t0\t0\tGATTACAG\t########\tPG:Z:strandwise"]
    with pytest.raises(ValueError, match="at most 1"):
        main([*many, "-e", "2"])


def test_schemes_are_checked(tmp_path):
    assert schemes.build("columba", 7) == schemes.build("minU", 7) and len(schemes.build("columba", 8)) == 9
    for name, k in schemes.SHOWN:
        assert not schemes.uncovered(schemes.build(name, k), k)
    assert all(not schemes.uncovered(x, 3) for x in schemes.with_mirrors([schemes.build("kuch1", 3)]))
    for text in ("{0,2,1} {0,0,0} {0,1,1}", "{0,1} {1,0} {1,1}", "{0,1} {0,2} {0,1}", "{1,2} {0,0} {0,1}", "{0,1} {0} {0,1}", "no search"):
        with pytest.raises(ValueError):
            schemes.parse(text)
    os.makedirs(tmp_path / "2")
    (tmp_path / "name.txt").write_text("own")
    (tmp_path / "2" / "scheme1.txt").write_text(schemes.KUCHEROV_1[2])
    (tmp_path / "2" / "scheme2.txt").write_text(schemes.KIANFAR[2])
    (tmp_path / "2" / "static_partitioning.txt").write_text("0.3 0.6")
    (tmp_path / "2" / "dynamic_partitioning.txt").write_text("0.5\n3 1 3\n")
    assert len(schemes.read_folder(str(tmp_path), 2)) == 2
    assert schemes.read_static_partitioning(str(tmp_path), 2, 3) == [0.3, 0.6]
    assert schemes.read_dynamic_partitioning(str(tmp_path), 2, 3) == ([0.5], [3, 1, 3])
    (tmp_path / "2" / "scheme1.txt").write_text("{0,1,2} {0,0,0} {0,1,2}")
    with pytest.raises(ValueError, match="cover"):
        schemes.read_folder(str(tmp_path), 2)


def test_static_boundaries_must_ascend(spark):
    with pytest.raises(ValueError):
        matching.static_parts(spark.createDataFrame([("r", "ACGT")], "read_id string, pattern string"), [0.5, 0.5])


def test_suffix_array_by_hand(spark):
    texts = spark.createDataFrame([(1, "ACGACG"), (2, "")], "text_id long, text string")
    sa = bwt.suffix_array(texts)
    b = bwt.bwt(sa)
    col = lambda df, c, order="i": [r[c] for r in df.where("text_id = 1").orderBy(order).collect()]
    assert col(sa, "sa") == [6, 3, 0, 4, 1, 5, 2]
    assert "".join(col(b, "b")) == "GG$AACC" and bwt.runs(b).where("text_id = 1").count() == 4
    assert col(bwt.lf_mapping(b), "lf") == [5, 6, 0, 1, 2, 3, 4]
    assert col(bwt.plcp(texts, sa), "plcp", "pos") == [3, 2, 1, 0, 0, 0, 0]


def test_streamed_reads_are_mapped_once(spark, tmp_path):
    refs = spark.createDataFrame([(0, "a", "TTACGTTTGGCA")], "seq_idx long, name string, seq string")
    for n, seq in enumerate(("ACGTTT", "TTGGCA")):
        spark.createDataFrame([(f"r{n}", seq)], "read_id string, seq string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id string, seq string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        map_stream(stream, refs, str(tmp_path / "out"), str(tmp_path / "state"), mapping.MapConfig()).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.read_id, r.begin) for r in got) == [("r0", 2), ("r1", 6)]


def test_human_readable_sizes_and_times():
    assert [sequence.human_size(n) for n in (0, 1023, 1024, 5 * 1024**3, 2048 * 1024**4)] == ["0 B", "1023 B", "1.00 KB", "5.00 GB", "2048.00 TB"]
    assert [sequence.human_time(s) for s in (0.5, 61, 3600, 3725.25)] == ["0.50s", "1m 1.00s", "1h 0m 0.00s", "1h 2m 5.25s"]
