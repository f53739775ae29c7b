"""Exact, Hamming and edit matching by seeds.

With at most k errors, one of the k + 1 parts of a read occurs without error. So every hit is found
by an equality join of the parts' first letters with the references' k-mers, and is then verified.
The join has no hint: Spark broadcasts the seeds of few reads and shuffles those of many.
References are read as tiles: short pieces with the letters that follow, so that neither k-mers nor
windows are cut from long strings, and a hit is verified against one tile.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import revcomp
from strandwise.operators import scan
from strandwise.sources.storage import written

#: Positions of a tile, and the seed lengths that k-mers are made of. Reads whose parts are shorter than the least of them are scanned for.
TILE, SEED_LENGTHS = 256, (4, 5, 6, 7, 9, 11, 13, 15)
#: Bytes of candidates beside their windows that are verified at a time.
VERIFIED_BYTES = 4 << 20
TILES = "seq_idx long, tile long, size long, body string"


def tiles(refs: DataFrame, flank: int) -> DataFrame:
    """(seq_idx, tile, size, body): TILE letters from TILE * tile on and up to flank more; size is the sequence's length."""
    return refs.select("seq_idx", "seq").mapInArrow(partial(_tile, flank=flank), TILES).repartition("seq_idx", "tile")


def _tile(batches, flank: int):
    names, kinds = ["seq_idx", "tile", "size", "body"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out = []
    for batch in batches:
        for idx, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at in range(0, len(seq or ""), TILE):
                out.append((idx, at // TILE, len(seq), seq[at : at + TILE + flank]))
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def kmers(tiled: DataFrame, lengths: list[int]) -> DataFrame:
    """(k, kmer, seq_idx, pos): every k-mer of every sequence, for each length."""
    each = tiled.withColumn("k", F.explode(F.array(*map(F.lit, lengths))))
    starts = F.expr(f"sequence(0, least({TILE}, size - tile * {TILE} - k + CASE WHEN k = 0 THEN 0 ELSE 1 END) - 1)")
    enough = F.expr(f"size - tile * {TILE} >= greatest(k, 1)")
    each = each.where(enough).withColumn("i", F.explode(starts))
    return each.select("k", F.expr("substring(body, i + 1, k)").alias("kmer"), "seq_idx", (F.col("tile") * TILE + F.col("i")).alias("pos"))


def strands(reads: DataFrame) -> DataFrame:
    """(read_id, strand, pattern): each read forward, and its reverse complement."""
    both = F.explode(F.array(F.struct(F.lit("FW").alias("strand"), F.col("seq").alias("pattern")), F.struct(F.lit("RC").alias("strand"), revcomp(F.col("seq")).alias("pattern"))))
    return reads.select("read_id", both.alias("s")).select("read_id", "s.strand", "s.pattern").where(F.length("pattern") > 0)


def uniform_parts(patterns: DataFrame, parts: int) -> DataFrame:
    """patterns with part, begin, end: boundaries at floor(i * m / parts)."""
    m = F.length("pattern")
    cut = patterns.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return cut.withColumn("begin", F.floor(F.col("part") * m / parts).cast("long")).withColumn("end", F.floor((F.col("part") + 1) * m / parts).cast("long"))


def static_parts(patterns: DataFrame, begins: list[float]) -> DataFrame:
    """patterns with part, begin, end: inner boundaries at begins * m, truncated."""
    if any(not 0 < a < 1 for a in begins) or any(a >= b for a, b in zip(begins, begins[1:])):
        raise ValueError("begins must ascend strictly within (0, 1)")
    m, table = F.length("pattern"), F.array(F.lit(0.0), *map(F.lit, begins), F.lit(1.0))
    cut = patterns.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(begins)))))
    at = lambda i: F.floor(F.element_at(table, i) * m).cast("long")
    return cut.withColumn("begin", at(F.col("part") + 1)).withColumn("end", at(F.col("part") + 2))


def candidates(patterns: DataFrame, tiled: DataFrame, k: int) -> DataFrame:
    """(read_id, strand, pattern, seq_idx, begin): where a part without errors puts the read's first letter. Parts have SEED_LENGTHS[0] letters or more."""
    seeds = uniform_parts(patterns, k + 1)
    length = F.lit(SEED_LENGTHS[0])
    for n in SEED_LENGTHS:
        length = F.when(F.col("end") - F.col("begin") >= n, n).otherwise(length)
    seeds = seeds.withColumn("k", length).withColumn("kmer", F.expr("substring(pattern, begin + 1, k)"))
    used = sorted(r.k for r in seeds.select("k").distinct().collect())  # at most len(SEED_LENGTHS)
    if not used:
        used = [SEED_LENGTHS[-1]]
    found = kmers(tiled, used).join(seeds, ["k", "kmer"])
    return found.select("read_id", "strand", "pattern", "seq_idx", (F.col("pos") - F.col("begin")).alias("begin")).distinct()


def _at_tile(found: DataFrame, tiled: DataFrame) -> DataFrame:
    placed = found.where("begin >= 0").withColumn("tile", F.floor(F.col("begin") / TILE).cast("long"))
    return placed.join(tiled, ["seq_idx", "tile"])


_HIT = "read_id string, strand string, seq_idx long, begin long, end long, distance long"


def exact_match(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Every locus of every read and strand; a read that is its own reverse complement is found on both."""
    return hamming_match(reads, refs, 0, distinct=False)


def longest(reads: DataFrame) -> int:
    return reads.agg(F.max(F.length("seq"))).first()[0] or 0


def _with_short(reads: DataFrame, refs: DataFrame, k: int, metric: str, most: int, join) -> DataFrame:
    """join's hits of the reads whose parts can be seeds, and those of shorter reads by scans, in groups that can be broadcast."""
    short = F.length("seq") < SEED_LENGTHS[0] * (k + 1)
    hits, few = join(reads.where(~short)), reads.where(short)
    letters = few.agg(F.sum(F.length("seq"))).first()[0] or 0
    groups = -(-letters // scan.MOST_LETTERS) if scan.MOST_LETTERS > 0 else int(letters > 0)
    for group in range(groups):
        part = few.where(F.pmod(F.xxhash64("read_id", "seq"), F.lit(groups)) == group)
        hits = hits.unionByName(scan.scan(part, refs, k, metric, most))
    return hits


def _few(reads: DataFrame) -> tuple[bool, int]:
    """(whether the reads are few enough to be broadcast, their greatest length), counted first."""
    letters, most = reads.agg(F.sum(F.length("seq")), F.max(F.length("seq"))).first()
    return (letters or 0) <= scan.MOST_LETTERS, most or 0


def hamming_match(reads: DataFrame, refs: DataFrame, k: int, *, distinct: bool = True, size: scan.Measured | None = None) -> DataFrame:
    """Hits (read_id, strand, seq_idx, begin, end, distance) with at most k substitutions, within one sequence.

    With distinct, a locus that both strands have at one distance is one hit, on the forward strand.
    Few reads are broadcast and found in one pass over the references; many are joined by their seeds. size: that of refs, if it is known.
    """
    few, most = _few(reads)
    if few and distinct:
        return _scan_once(reads, refs, k, "hamming", most, size)
    hits = scan.scan(reads, refs, k, "hamming", most) if few else _with_short(reads, refs, k, "hamming", most, lambda own: hamming_join(own, refs, k, most))
    return one_strand(hits) if distinct else hits


def _scan_once(reads: DataFrame, refs: DataFrame, k: int, metric: str, most: int, size: scan.Measured | None) -> DataFrame:
    """What one_strand or nonredundant leaves of scan's hits.

    All hits at a place, and all in a sequence that is one piece, are found by one task at a time, which leaves out the others: no hit is
    shuffled. Those in longer sequences are, with edit distances, and all are where reads or sequences share a name.
    """
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    size = size or scan.measured(refs)
    cut, shared = scan.pieces(refs, most + k, most + k, size.letters), scan.shared_patterns(reads.sparkSession, rows, k)
    found = lambda of: scan.match_shared(cut, shared, k, metric, of=of)
    if not size.alone or not named_apart(rows):
        return one_strand(found(None)) if metric == "hamming" else nonredundant(found(None), k)
    if metric == "hamming":
        return found("strands")
    return found("whole") if size.longest <= scan.PIECE else found("whole").unionByName(nonredundant(found("cut"), k))


def named_apart(rows: list[tuple[str, str]]) -> bool:
    return len({name for name, _ in rows}) == len(rows)


def hamming_join(reads: DataFrame, refs: DataFrame, k: int, most: int) -> DataFrame:
    tiled = tiles(refs, most)
    return verified(_at_tile(candidates(strands(reads), tiled, k), tiled), k, "hamming")


def verified(found: DataFrame, k: int, metric: str) -> DataFrame:
    """Hits among candidates (read_id, strand, pattern, seq_idx, begin) that stand beside their tile (tile, size, body)."""
    if metric == "edit" and k:
        window = F.expr(f"substring(body, begin - tile * {TILE} + 1, length(pattern) + {k})")
        return found.select("read_id", "strand", "seq_idx", "begin", "pattern", window.alias("window")).where(F.length("window") > 0).mapInArrow(partial(_edit, k=k), _HIT)
    found = found.where(F.col("begin") + F.length("pattern") <= F.col("size"))
    window = F.expr(f"substring(body, begin - tile * {TILE} + 1, length(pattern))")
    if k == 0:
        return found.where(window == F.col("pattern")).select("read_id", "strand", "seq_idx", "begin", (F.col("begin") + F.length("pattern")).alias("end"), F.lit(0).cast("long").alias("distance"))
    return found.select("read_id", "strand", "seq_idx", "begin", "pattern", window.alias("window")).mapInArrow(partial(_hamming, k=k), _HIT)


def one_strand(hits: DataFrame) -> DataFrame:
    return hits.groupBy("read_id", "seq_idx", "begin", "end", "distance").agg(F.min("strand").alias("strand")).select("read_id", "strand", "seq_idx", "begin", "end", "distance")


def _rows(batch, keep, begin, end, distance):
    take = pa.array(keep)
    columns = [batch.column(n).take(take) for n in ("read_id", "strand", "seq_idx")]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (begin, end, distance))], names=["read_id", "strand", "seq_idx", "begin", "end", "distance"])


def _lengths(column) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _hamming(batches, k: int):
    """Letters of all rows side by side; ends of rows cut the sum of differences."""
    for batch in batches:
        sizes = _lengths(batch.column("pattern"))
        letters = [np.frombuffer("".join(batch.column(c).to_pylist()).encode("ascii", "replace"), np.uint8) for c in ("pattern", "window")]
        total = np.concatenate([[0], np.cumsum(letters[0] != letters[1])])
        ends = np.cumsum(sizes)
        d = total[ends] - total[ends - sizes]
        keep = np.flatnonzero(d <= k)
        begin = batch.column("begin").to_numpy()[keep]
        yield _rows(batch, keep, begin, begin + sizes[keep], d[keep])


def edit_starts(reads: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """For every start within one sequence: the least edit distance of the read to a string from there, if at most k, and the shortest such string."""
    few, most = _few(reads)
    return scan.scan(reads, refs, k, "edit", most) if few else _with_short(reads, refs, k, "edit", most, lambda own: edit_join(own, refs, k, most))


def edit_join(reads: DataFrame, refs: DataFrame, k: int, most: int) -> DataFrame:
    tiled = tiles(refs, most + k)
    near = candidates(strands(reads), tiled, k).withColumn("begin", F.explode(F.expr(f"sequence(begin - {k}, begin + {k})"))).distinct()
    return verified(_at_tile(near, tiled), k, "edit")


def _gathered(batches, most: int):
    """Batches side by side, of about most bytes: rows of one length are verified at once, and small batches have few of them."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edit(batches, k: int):
    for batch in _gathered(batches, VERIFIED_BYTES):
        sizes, widths = _lengths(batch.column("pattern")), _lengths(batch.column("window"))
        windows = np.frombuffer("".join(batch.column("window").to_pylist()).encode("ascii", "replace"), np.uint8)
        patterns = batch.column("pattern").to_pylist()
        at = np.cumsum(widths) - widths
        for m in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == m)
            texts = np.frombuffer("".join(patterns[i] for i in own.tolist()).encode("ascii", "replace"), np.uint8).reshape(-1, m)
            d, width = scan.edit(windows, at[own], widths[own], texts, k)
            keep = own[d <= k]
            begin = batch.column("begin").to_numpy()[keep]
            yield _rows(batch, keep, begin, begin + width[d <= k], d[d <= k])


def nonredundant(hits: DataFrame, k: int) -> DataFrame:
    """Hits of a read in a sequence, thinned in order of begin, distance, width and strand.

    A hit within 2 * k of the last kept one is dropped unless its distance is less, or equal with a
    smaller width; then it takes its place. One at the same begin is dropped. Groups are streamed.
    """
    order = hits.withColumn("width", F.col("end") - F.col("begin"))
    order = order.repartition("read_id", "seq_idx").sortWithinPartitions("read_id", "seq_idx", "begin", "distance", "width", "strand")
    return order.drop("width").select("read_id", "strand", "seq_idx", "begin", "end", "distance").mapInArrow(partial(_thin, reach=2 * k), _HIT)


def _thin(batches, reach: int):
    last = None  # the last kept hit, a batch of one row, goes before the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
        own = [joined.column(c) for c in ("read_id", "seq_idx")]
        same = pc.and_(*(pc.equal(c.slice(1), c.slice(0, len(c) - 1)) for c in own)).to_numpy(zero_copy_only=False)
        begin, end, distance = (joined.column(c).to_numpy() for c in ("begin", "end", "distance"))
        kept, at = scan.thinned(same, begin, distance * (1 << 32) + end - begin, reach)
        if kept:
            yield joined.take(pa.array(kept))
        last = joined.take(pa.array([at]))
    if last is not None:
        yield last


def edit_match(reads: DataFrame, refs: DataFrame, k: int, *, size: scan.Measured | None = None) -> DataFrame:
    """Non-redundant hits with at most k substitutions, insertions and deletions. With k = 0, exact hits. size: that of refs, if it is known."""
    if k == 0:
        return exact_match(reads, refs)
    few, most = _few(reads)
    return _scan_once(reads, refs, k, "edit", most, size) if few else nonredundant(edit_starts(reads, refs, k), k)


def found(reads: DataFrame, refs: DataFrame, k: int, metric: str) -> DataFrame:
    """Hits of both strands, or every start with edit distances, before strands or starts are thinned."""
    return edit_starts(reads, refs, k) if metric == "edit" and k else hamming_match(reads, refs, k, distinct=False)


def found_in(reads: DataFrame, refs: DataFrame, cut: DataFrame, k: int, metric: str) -> DataFrame:
    """found, where few reads are searched for in pieces of refs that were cut before: scan.pieces, with flanks that hold the longest read and its errors."""
    if not _few(reads)[0]:
        return found(reads, refs, k, metric)
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    return scan.match_pieces(cut, rows, k, metric)


def best_match(reads: DataFrame, k: int, beyond: int, metric: str, find) -> DataFrame:
    """Hits within beyond errors of each read's best, at most k, by rounds of growing k: find(reads, k) gives a round's hits.

    A round takes only the reads that are not settled: one is, once its best and beyond more errors are within the
    round's k. So most reads are never searched with many errors. Rounds are written; they follow k alone. The result is
    that of one search with k: hits with more errors never decide which of those with fewer are kept.
    """
    now, left, settled = 0, reads.select("read_id", "seq"), []
    while True:
        hits = written(find(left, now), "round")
        best = hits.groupBy(F.col("read_id").alias("_of")).agg(F.min("distance").alias("_best"))
        if now < k:
            best = best.where(F.col("_best") + beyond <= now)
        best = written(best, "best")
        settled.append(hits.join(best, F.col("read_id") == F.col("_of")).where(F.col("distance") <= F.col("_best") + beyond).drop("_of", "_best"))
        if now == k:
            break
        left = written(left.join(best, F.col("read_id") == F.col("_of"), "left_anti"), "unsettled")
        if left.isEmpty():
            break
        now = min(k, max(beyond, 1) if now == 0 else now + beyond + (2 if now < 5 else 4))
    hits = settled[0]
    for more in settled[1:]:
        hits = hits.unionByName(more)
    if k == 0:
        return hits
    return nonredundant(hits, k) if metric == "edit" else one_strand(hits)


def cluster_centres(starts: DataFrame) -> DataFrame:
    """Starts whose distance is no more than that at the starts next to them, of one read, strand and sequence."""
    line = Window.partitionBy("read_id", "strand", "seq_idx").orderBy("begin")
    near = lambda f, step: F.when(f("begin").over(line) == F.col("begin") + step, f("distance").over(line))
    left, right = near(F.lag, -1), near(F.lead, 1)
    flagged = starts.withColumn("_centre", (F.coalesce(left, F.col("distance")) >= F.col("distance")) & (F.coalesce(right, F.col("distance")) >= F.col("distance")))
    return flagged.where("_centre").drop("_centre")


def selective_seeds(patterns: DataFrame, tiled: DataFrame, k: int, length: int) -> DataFrame:
    """For each part of each pattern the k-mer within it that the references hold least often, the leftmost of equals.

    (read_id, strand, part, begin, kmer, occurrences). Any of them finds what the part's first does;
    the rarest brings the fewest candidates. Parts shorter than length have none.
    """
    counts = kmers(tiled, [length]).groupBy("kmer").agg(F.count(F.lit(1)).alias("occurrences"))
    parts = uniform_parts(patterns, k + 1).where(F.col("end") - F.col("begin") >= length)
    each = parts.withColumn("at", F.explode(F.expr(f"sequence(begin, end - {length})"))).withColumn("kmer", F.expr(f"substring(pattern, cast(at AS int) + 1, {length})"))
    known = each.join(counts, "kmer", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    best = known.groupBy("read_id", "strand", "part").agg(F.min(F.struct("occurrences", "at", "kmer")).alias("b"))
    return best.select("read_id", "strand", F.col("part").cast("long").alias("part"), F.col("b.at").alias("begin"), F.col("b.kmer").alias("kmer"), F.col("b.occurrences").alias("occurrences"))


def seed_guard(patterns: DataFrame, parts: int) -> DataFrame:
    """patterns with naive: true where parts would have no letter, or there is only one, so that seeds can't lead a search."""
    return patterns.withColumn("naive", (F.length("pattern") <= parts) | F.lit(parts == 1))


def part_to_grow(parts: DataFrame, widths: DataFrame, weights: list[int], length: int) -> DataFrame:
    """(read_id, strand, part, width): of each pattern's parts the one with the greatest width * weight, the leftmost of equals.

    A part's width is how often widths(kmer, occurrences) has its first letters, so many of them.
    It is the step that a partitioning by selectivity repeats: the part with most matches grows.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("part").cast("int") + 1)
    seeds = parts.withColumn("kmer", F.expr(f"substring(pattern, cast(begin AS int) + 1, {length})"))
    known = seeds.join(widths, "kmer", "left").withColumn("width", F.coalesce("occurrences", F.lit(0)).cast("long"))
    best = known.groupBy("read_id", "strand").agg(F.min(F.struct((-F.col("width") * weight).alias("order"), "part", "width")).alias("b"))
    return best.select("read_id", "strand", F.col("b.part").cast("long").alias("part"), "b.width")


def planned_searches(patterns: DataFrame, schemes: DataFrame) -> DataFrame:
    """Patterns times the searches of one scheme, which has a few rows: (read_id, strand, search_idx, part, begin, end) of the part that each starts with."""
    few = F.broadcast(schemes.select("search_idx", F.element_at("pi", 1).alias("part"), F.size("pi").alias("parts")))
    size, at = F.length("pattern"), F.col("part")
    bounds = [F.floor(x * size / F.col("parts")).cast("long").alias(n) for n, x in (("begin", at), ("end", at + 1))]
    return patterns.crossJoin(few).select("read_id", "strand", "search_idx", "part", *bounds)
