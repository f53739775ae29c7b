"""FASTA and FASTQ sources, SAM and hit-list sinks, and the seed index on disk."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.sequence import ascii_upper, header_name, mask_ambiguous
from strandwise.operators.intervals import running_sum
from strandwise.sources import datasource
from strandwise.sources.datasource import FASTA_ENDINGS, FASTQ_ENDINGS
from strandwise.sources.storage import written


def read_reference_fasta(spark: SparkSession, path: str, *, range_bytes: int = datasource.RANGE_BYTES, kind: str = "") -> DataFrame:
    """seq_idx (from 0, in order of file and place), name (header up to the first space), seq (upper case; empty records stay), len."""
    records = datasource.read(spark, path, range_bytes, kind)
    # numbers take three passes and a join: files are parsed once, with small ranges side by side in a task
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-records.rdd.getNumPartitions() * range_bytes // datasource.RANGE_BYTES))
    records = written(records.select("at", "header", "seq").coalesce(tasks), "records").withColumn("one", F.lit(1).cast("long"))
    order = running_sum(records.select("at", "one"), "at", "one", "seq_idx").select(F.col("at").alias("_at"), "seq_idx")
    out = records.join(order, F.col("at") == F.col("_at")).select("seq_idx", header_name(F.col("header")).alias("name"), ascii_upper(F.col("seq")).alias("seq"))
    return out.withColumn("len", F.length("seq").cast("long"))


def read_text_reference(spark: SparkSession, path: str) -> DataFrame:
    """A plain text as one sequence that has the file's base name."""
    name = os.path.basename(path).rpartition(".")[0] or os.path.basename(path)
    seq = ascii_upper(F.regexp_replace(F.col("value"), "\\s|\\$", ""))
    return spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("seq_idx"), F.lit(name).alias("name"), seq.alias("seq")).withColumn("len", F.length("seq").cast("long"))


def read_fastq(spark: SparkSession, path: str, *, with_place: bool = False, range_bytes: int = datasource.RANGE_BYTES, kind: str = "") -> DataFrame:
    """read_id (header without its first character), seq (N for all but ACGT), qual, from records of four lines.

    Files are read in ranges of bytes, without a shuffle. With with_place also at, by which reads stand in input order.
    """
    return _reads(datasource.read(spark, path, range_bytes, kind), F.col("header"), with_place)


def _reads(records: DataFrame, read_id: Column, with_place: bool = False) -> DataFrame:
    place = [F.col("at")] if with_place else []
    return records.select(*place, read_id.alias("read_id"), mask_ambiguous(F.col("seq")).alias("seq"), "qual")


def read_reads(spark: SparkSession, path: str, *, with_place: bool = False) -> DataFrame:
    """Reads by file ending (also before .gz): FASTQ, or FASTA with an empty quality."""
    ending = datasource.ending(path)
    if ending in FASTQ_ENDINGS:
        return read_fastq(spark, path, with_place=with_place)
    if ending not in FASTA_ENDINGS:
        raise ValueError(f"{path}: reads must end in one of {', '.join(FASTA_ENDINGS + FASTQ_ENDINGS)}")
    return _reads(datasource.read(spark, path), header_name(F.col("header")), with_place)


def reference_path(base: str) -> tuple[str, str]:
    """(mode, path) for a base name: a text if it is there, else the first FASTA ending that is."""
    if os.path.exists(f"{base}.txt"):
        return "text", f"{base}.txt"
    for ending in FASTA_ENDINGS:
        if os.path.exists(f"{base}.{ending}"):
            return "fasta", f"{base}.{ending}"
    raise FileNotFoundError(f"neither {base}.txt nor {base} with any of {', '.join(FASTA_ENDINGS)}")


def write_fasta(refs: DataFrame, path: str, width: int = 60) -> None:
    """refs(seq_idx, name, seq) in order of seq_idx, letters in lines of width; a range sort, no single task."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    refs.orderBy("seq_idx").select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("line")).write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """reads(read_id, seq, qual) in four lines each, in order of read_id."""
    reads.orderBy("read_id").select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("line")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """lines(kind, key, line) as text in order of kind (headers first) and key; a range sort, no single task."""
    lines.orderBy("kind", "key", "line").select("line").write.mode("overwrite").text(path)


def write_preprocessed(refs: DataFrame, path: str) -> None:
    """The sequences and their reverses, one line each."""
    refs.orderBy("seq_idx").select("seq").write.mode("overwrite").text(f"{path}/text")
    refs.orderBy(F.desc("seq_idx")).select(F.reverse("seq").alias("seq")).write.mode("overwrite").text(f"{path}/reverse")
