"""FASTA and FASTQ ranges, wherever they are cut, against the files read as a whole."""

import gzip

import pytest

from strandwise.sources import datasource, sequences
from strandwise.sources.datasource import Range, read_range


def all_records(path, size, fastq):
    n = path.stat().st_size
    parts = [Range(str(path), 3, at, min(n, at + size), fastq) for at in range(0, n, size)]
    return [r for p in parts for b in read_range(p) for r in zip(*(c.to_pylist() for c in b.columns))]


FASTQ = "".join(f"@r{i} x{end}ACG{'T' * (i % 5)}{end}+{'r' * (i % 2)}{end}{q}{end}" for end in ("\n",) for i in range(60) for q in ["@+>I"[i % 4] * (3 + i % 5)])
FASTA = ">one first\nACGT\nac\r\n>two\n\n>three x\nGG\n" + "".join(f">n{i}\n" + "ACGTACGT\n" * (i % 4) for i in range(40)) + "@last\nAC"


@pytest.mark.parametrize("size", [1, 2, 7, 13, 64, 1 << 20])
def test_ranges_join_up(tmp_path, monkeypatch, size):
    monkeypatch.setattr(datasource, "READ_BYTES", 11)
    (tmp_path / "q.fq").write_bytes(FASTQ.encode())
    lines = FASTQ.split("\n")
    want = [(lines[i][1:], lines[i + 1], lines[i + 3]) for i in range(0, len(lines) - 3, 4)]
    got = all_records(tmp_path / "q.fq", size, True)
    assert [r[1:] for r in got] == want and [r[0] for r in got] == sorted(r[0] for r in got) and got[0][0] == 3 << datasource.PLACE_BITS
    (tmp_path / "r.fa").write_bytes(FASTA.encode())
    got = all_records(tmp_path / "r.fa", size, False)
    want = [("one first", "ACGTac"), ("two", ""), ("three x", "GG")] + [(f"n{i}", "ACGTACGT" * (i % 4)) for i in range(40)] + [("last", "AC")]
    assert [r[1:3] for r in got] == want and all(r[3] == "" for r in got)


def test_wrong_records_are_refused(tmp_path):
    for n, text in enumerate(("r1\nA\n+\nI\n", "@r1\nA\n+\nI\n@r2\nA\n", "@r1\nA\n-\nI\n")):
        (tmp_path / f"{n}.fq").write_text(text)
        with pytest.raises(ValueError, match="FASTQ"):
            all_records(tmp_path / f"{n}.fq", 1 << 20, True)


def test_folders_compressed_files_and_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.fq").write_text("@b1\nAC\n+\nII\n\n@b2\nGN\n+\nII\n")
    (tmp_path / "in" / "a.fastq.gz").write_bytes(gzip.compress(b"@a1\nAC\n+\nII\n" * 3))
    (tmp_path / "in" / "notes.txt").write_text("not a read")
    df = sequences.read_fastq(spark, str(tmp_path / "in"), with_place=True, range_bytes=5)
    assert [r.read_id for r in sorted(df.collect())] == ["a1"] * 3 + ["b1", "b2"]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert datasource.read(spark, f"file://{tmp_path}/in/b.fq").count() == 2
    (tmp_path / "empty.fa").write_text("")
    assert sequences.read_reference_fasta(spark, str(tmp_path / "empty.fa")).count() == 0
    with pytest.raises(Exception, match="nothing"):
        datasource.read(spark, str(tmp_path / "nothing.fq")).count()


def test_files_are_streamed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        stream = datasource.read_stream(spark, str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.header for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.fq").write_text("@a\nAC\n+\nII\n")
    assert run() == ["a"]
    (tmp_path / "in" / "b.fq").write_text("@b\nAC\n+\nII\n")
    assert run() == ["a", "b"] == run()
