"""A persisted index of references: pieces for scans, k-mers and tiles in buckets for joins.

Building shuffles the references once. Mapping then shuffles none of them: a scan reads pieces as
they lie, and a join reads k-mers in the buckets of their number and tiles in those of their place, so
only seeds and candidates move. Each k-mer has the letters behind it, so that a seed is met where the whole part stands (up to
AHEAD letters more), and a frequent k-mer is dealt over parts, each in a bucket of its own. Few reads are broadcast and scanned for, many are joined; reads whose parts are
shorter than the index's seeds are scanned for in any case, in groups that can be broadcast.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators import matching, scan
from strandwise.sources.storage import qualified

#: Written into each index; readers refuse any other.
VERSION = 3
#: Letters of a seed, letters around a piece (the longest read and its errors must fit), letters of the references that a bucket is made for (a row
#: each, some 20 bytes), and the most buckets that Spark allows.
SEED, FLANK, BUCKET_LETTERS, MOST_BUCKETS = 11, 512, 4 << 20, 100_000
#: Letters behind a k-mer that its row holds as a number of base 5, first letter first (31 bits); places of one k-mer that a part of it is made for, and
#: letters of the windows whose counts bound these.
AHEAD, PART_PLACES, COUNTED = 13, 1 << 20, 6


@dataclass(frozen=True)
class SeedIndex:
    """Tables of an index: refs(seq_idx, name, seq), pieces as scan.pieces makes them, kmers(kmer, part, seq_idx, pos, ahead), tiles(seq_idx, tile, size, body)."""

    refs: DataFrame
    pieces: DataFrame
    kmers: DataFrame
    tiles: DataFrame
    seed: int
    flank: int
    buckets: int
    parts: int


def _first_letter_first(letters: np.ndarray, k: int) -> np.ndarray:
    """As scan.packed, but in the order of strings: those that begin alike are numbers of one range."""
    return scan.packed(letters[::-1], k)[::-1]


def _kmers(batches, k: int):
    """(kmer, seq_idx, pos, ahead) of every k-mer that starts within a piece: packed numbers, see scan.packed, and the AHEAD letters behind them.

    What stands behind the end of a sequence is any number: no part of a read reaches there.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        idx, first, lead, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seq_idx", "first", "lead", "own"))
        bodies = batch.column("body").to_pylist()
        sizes = np.array([len(b) for b in bodies], np.int64)
        letters = np.frombuffer(b"".join(bodies), np.uint8)
        if len(letters) < k:
            continue
        base = np.cumsum(sizes) - sizes
        number = scan.packed(letters, k).astype(np.int64)
        behind = _first_letter_first(np.concatenate([letters[k:], np.zeros(AHEAD, np.uint8)]), AHEAD).astype(np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)[: len(number)]
        at = np.arange(len(number)) - base[row]
        mine = np.flatnonzero((at >= lead[row]) & (at < lead[row] + own[row]) & (at + k <= sizes[row]))
        for lo in range(0, len(mine), 1 << 18):
            some = mine[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(idx[row[some]]), pa.array(first[row[some]] + at[some] - lead[row[some]]), pa.array(behind[some])], names=["kmer", "seq_idx", "pos", "ahead"])


def _window_counts(batches, length: int):
    """(kmer, n) by batch. Few letters, so that an array holds all counts."""
    for batch in _kmers(batches, length):
        n = np.bincount(batch.column("kmer").to_numpy(), minlength=5**length)
        kmers = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(kmers), pa.array(n[kmers].astype(np.int64))], names=["kmer", "n"])


def _table_name(path: str, what: str) -> str:
    return f"strandwise_{what}_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def build(refs: DataFrame, path: str, *, seed: int = SEED, flank: int = FLANK, buckets: int | None = None) -> SeedIndex:
    """Writes the index of refs(seq_idx, name, seq) to path and reads it back. Null and empty sequences have no seeds.

    Buckets follow the size of the references unless they are given; the parts of each k-mer follow the count of the most
    frequent one, bounded by that of its first letters. A sequence of any length is cut into pieces and tiles of
    bounded size; no task holds more than its Arrow batch of them.
    """
    if not 1 <= seed <= scan.LONGEST_SEED:
        raise ValueError(f"seed must lie within 1 and {scan.LONGEST_SEED}")
    spark = refs.sparkSession
    path = qualified(spark, path)
    refs.select("seq_idx", "name", "seq").write.mode("overwrite").parquet(f"{path}/refs")
    refs = spark.read.parquet(f"{path}/refs")
    if buckets is None:
        letters = refs.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-letters // BUCKET_LETTERS)))
    scan.pieces(refs, flank, max(flank, seed + AHEAD)).write.mode("overwrite").parquet(f"{path}/pieces")
    pieces = spark.read.parquet(f"{path}/pieces")
    counted = pieces.mapInArrow(partial(_window_counts, length=min(seed, COUNTED)), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
    parts = -(-(counted.agg(F.max("n")).first()[0] or 1) // PART_PLACES)
    part = F.pmod(F.xxhash64("seq_idx", F.shiftright("pos", 12)), F.lit(parts)).alias("part")
    kmers = pieces.mapInArrow(partial(_kmers, k=seed), "kmer long, seq_idx long, pos long, ahead int").select("kmer", part, "seq_idx", "pos", "ahead")
    _write_buckets(kmers, path, "kmers", buckets, ["kmer", "part"])
    _write_buckets(refs.select("seq_idx", "seq").mapInArrow(partial(matching._tile, flank=flank), matching.TILES), path, "tiles", buckets, ["seq_idx", "tile"])
    meta = json.dumps({"version": VERSION, "seed": seed, "flank": flank, "buckets": buckets, "parts": parts})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")  # last: what has it is whole
    return load(spark, path)


def _write_buckets(df: DataFrame, path: str, what: str, buckets: int, by: list[str]) -> None:
    """A file for each bucket, sorted; the shuffle has a partition for each, so that no task writes to many buckets."""
    name = _table_name(path, what)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", f"{path}/{what}").format("parquet").saveAsTable(name)


def load(spark: SparkSession, path: str) -> SeedIndex:
    """The index at path, in any session: its bucketed tables are declared over their files."""
    path = qualified(spark, path)
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    if meta.get("version") != VERSION:
        raise ValueError(f"{path} was written by another version; build it again")
    tables = {}
    for what, columns, by in (("kmers", "kmer BIGINT, part BIGINT, seq_idx BIGINT, pos BIGINT, ahead INT", "kmer, part"), ("tiles", "seq_idx BIGINT, tile BIGINT, size BIGINT, body STRING", "seq_idx, tile")):
        name = _table_name(path, what)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {meta['buckets']} BUCKETS LOCATION '{path}/{what}'")
        tables[what] = spark.table(name)
    return SeedIndex(spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/pieces"), tables["kmers"], tables["tiles"], meta["seed"], meta["flank"], meta["buckets"], meta["parts"])


_SEED = "read_id string, strand string, pattern string, offset long, number long, least int, most int"


def _pack(batches, k: int):
    """The number of each seed, as in _kmers, and the least and the greatest of the numbers ahead that begin with the letters ahead of it."""
    for batch in batches:
        text = "".join(batch.column("kmer").to_pylist()).encode("ascii", "replace")
        number = scan.packed(np.frombuffer(text, np.uint8), k)[::k].astype(np.int64) if text else np.zeros(0, np.int64)
        ahead, bounds = batch.column("ahead").to_pylist(), []
        for fill in "AN":  # the least letter and the greatest
            text = "".join(x.ljust(AHEAD, fill) for x in ahead).encode("ascii", "replace")
            bounds.append(_first_letter_first(np.frombuffer(text, np.uint8), AHEAD)[::AHEAD].astype(np.int32) if text else np.zeros(0, np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("read_id"), batch.column("strand"), batch.column("pattern"), batch.column("begin"), pa.array(number), *map(pa.array, bounds)],
            names=["read_id", "strand", "pattern", "offset", "number", "least", "most"],
        )


def candidates(reads: DataFrame, index: SeedIndex, k: int) -> DataFrame:
    """(read_id, strand, pattern, seq_idx, begin), with repeats: where the first letters of a part without errors, index.seed + AHEAD at most, put the
    read. Parts have index.seed letters or more."""
    parts = matching.uniform_parts(matching.strands(reads), k + 1).withColumn("kmer", F.expr(f"substring(pattern, cast(begin AS int) + 1, {index.seed})"))
    parts = parts.withColumn("ahead", F.expr(f"substring(pattern, cast(begin AS int) + 1 + {index.seed}, least(cast(end - begin AS int) - {index.seed}, {AHEAD}))"))
    seeds = parts.select("read_id", "strand", "pattern", "begin", "kmer", "ahead").mapInArrow(partial(_pack, k=index.seed), _SEED)
    seeds = seeds.withColumn("of_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.parts - 1).cast("long"))))
    on = (F.col("kmer") == F.col("number")) & (F.col("part") == F.col("of_part")) & F.col("ahead").between(F.col("least"), F.col("most"))
    return index.kmers.join(seeds.hint("shuffle_merge"), on).select("read_id", "strand", "pattern", "seq_idx", (F.col("pos") - F.col("offset")).alias("begin"))


def _joined(reads: DataFrame, index: SeedIndex, k: int, metric: str) -> DataFrame:
    found = candidates(reads, index, k)
    if metric == "edit" and k:
        found = found.withColumn("begin", F.explode(F.expr(f"sequence(begin - {k}, begin + {k})")))
    placed = found.where("begin >= 0").withColumn("at", F.floor(F.col("begin") / matching.TILE).cast("long")).withColumnRenamed("seq_idx", "of")
    placed = placed.repartition(index.buckets, "of", "at").distinct()  # one shuffle: it also serves the join
    tiled = index.tiles.join(placed.hint("shuffle_merge"), (F.col("seq_idx") == F.col("of")) & (F.col("tile") == F.col("at")))
    return matching.verified(tiled, k, metric)


def match(reads: DataFrame, index: SeedIndex, k: int, metric: str = "edit", *, most_letters: int | None = None) -> DataFrame:
    """Hits of reads(read_id, seq) in the index, as matching.hamming_match and matching.edit_match give them.

    Reads of at most most_letters letters in all (scan.MOST_LETTERS) are scanned for; of more, those whose parts have
    index.seed letters are joined and the others scanned for in groups. Null and empty reads have no hits. The
    longest read and its errors must fit into the index's flank.
    """
    hits = found(reads, index, k, metric, most_letters=most_letters)
    if metric == "edit" and k:
        return matching.nonredundant(hits, k)
    return hits if k == 0 else matching.one_strand(hits)


def found(reads: DataFrame, index: SeedIndex, k: int, metric: str, *, most_letters: int | None = None, counters: scan.Counters | None = None) -> DataFrame:
    """match without its last step: hits of both strands, or every start with edit distances. counters count what scans meet."""
    if metric not in ("edit", "hamming"):
        raise ValueError("metric must be edit or hamming")
    size = F.length("seq")
    most_letters = scan.MOST_LETTERS if most_letters is None else most_letters
    letters, longest = reads.agg(F.sum(size), F.max(size)).first()
    letters, longest = letters or 0, longest or 0
    if longest + k > index.flank:
        raise ValueError(f"reads of {longest} letters with {k} errors need an index with a flank of as many letters; build it anew")
    if letters <= most_letters:
        hits = _scanned(reads, index, k, metric, counters)
    else:
        short = size < index.seed * (k + 1)
        hits = _joined(reads.where(~short), index, k, metric)
        few = reads.where(short)
        left = few.agg(F.sum(size)).first()[0] or 0
        groups = -(-left // scan.MOST_LETTERS)
        for group in range(groups):  # as many as the short reads' letters need
            part = few.where(F.pmod(F.xxhash64("read_id", "seq"), F.lit(groups)) == group)
            hits = hits.unionByName(_scanned(part, index, k, metric, counters))
    return hits


def _scanned(reads: DataFrame, index: SeedIndex, k: int, metric: str, counters: scan.Counters | None) -> DataFrame:
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    return scan.match_pieces(index.pieces, rows, k, metric, counters=counters)
