"""Intervals and the points within them, without a window over everything: running sums, as-of joins by bins, references as one text."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators import scan
from strandwise.sources.storage import written

#: Ranges of the order in which running sums are taken, and the accuracy of their bounds.
RANGES, ACCURACY = 256, 10_000


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over all rows whose order (a long, not null and not repeated) is smaller.

    Rows are cut at quantiles of order into RANGES ranges; the sums of ranges, a row for each, are summed first, then
    rows within their range. Any ranges give the same result, so quantiles may be rough.
    """
    bounds = rows.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], ACCURACY)).first()[0] or []
    table = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<bigint>")
    at = F.size(F.filter(table, lambda b: b <= F.col(order)))
    ranged = rows.withColumn("_range", at)
    before = F.sum("_sum").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))  # at most RANGES rows
    sums = ranged.groupBy(F.col("_range").alias("_of")).agg(F.sum(value).alias("_sum")).select("_of", F.coalesce(before, F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(sums), F.col("_range") == F.col("_of"))  # at most RANGES rows
    return joined.withColumn(name, (F.col("_before") + F.coalesce(F.sum(value).over(own), F.lit(0))).cast("long")).drop("_range", "_of", "_before")


def sequence_offsets(refs: DataFrame) -> DataFrame:
    """(seq_idx, len, start_pos): where each sequence starts in the text of all, in order of seq_idx."""
    sizes = refs.select("seq_idx", F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("len"))
    return running_sum(written(sizes, "lengths"), "seq_idx", "len", "start_pos")  # which reads them three times


def within(points: DataFrame, point: Column, intervals: DataFrame, start: str, end: str, *, how: str = "inner", by: tuple[str, ...] = ()) -> DataFrame:
    """points beside the interval [start, end) that holds point; intervals don't overlap (within equal values of by, columns of both).

    A join by bins of equal width: an interval is in each bin that it meets, a point in one. The width
    is a power of two that is at least the mean interval, so bins are at most twice as many as intervals and a bin
    for each; no side is sorted as a whole, and Spark can split a bin with very many points. Columns of both sides must differ, but for by.
    """
    n, total = intervals.where(F.col(end) > F.col(start)).agg(F.count(F.lit(1)), F.sum(F.col(end) - F.col(start))).first()
    bits = max(0, (-(-(total or 0) // max(1, n)) - 1).bit_length())
    bins = F.sequence(F.shiftright(start, bits), F.shiftright(F.col(end) - 1, bits))
    held = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    held = held.select(*(F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in held.columns))
    met = points.withColumn("_at", point.cast("long")).withColumn("_at_bin", F.shiftright("_at", bits))
    on = (F.col("_at_bin") == F.col("_bin")) & (F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(end))
    for c in by:
        on &= F.col(c) == F.col(f"_{c}")
    return met.join(held, on, how).drop("_at", "_at_bin", "_bin", *(f"_{c}" for c in by))


def _slices(batches, flank: int, piece: int):
    """(first, at, part): letters of each sequence for each piece of the text of all whose letters or flanks they are in."""
    for batch in batches:
        out, size = [], 0
        for seq, start in zip(batch.column("seq").to_pylist(), batch.column("start_pos").to_pylist()):
            raw = (seq or "").encode("ascii", "replace")
            if not raw:
                continue
            end = start + len(raw)
            for first in range(max(0, (start - flank) // piece) * piece, end + flank, piece):
                lo, hi = max(start, first - flank), min(end, first + piece + flank)
                if lo < hi:
                    out.append((first, lo, raw[lo - start : hi - start]))
                    size += hi - lo
                if size >= 1 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)


def _batch(rows):
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["first", "at", "part"])


def text_of_all(refs: DataFrame, offsets: DataFrame, flank: int, piece: int = scan.PIECE) -> DataFrame:
    """Pieces of piece letters (see scan.pieces) of all sequences side by side in order of seq_idx, as one sequence 0. Each is put together from the
    slices that fall into it, so no task holds more than pieces; sequences may be of any length, and empty."""
    if not 0 <= flank < piece:
        raise ValueError(f"flank must be less than {piece}")
    starts = offsets.select(F.col("seq_idx").alias("of"), "start_pos")
    placed = refs.join(starts, F.col("seq_idx") == F.col("of")).select("seq", "start_pos")
    slices = placed.mapInArrow(partial(_slices, flank=flank, piece=piece), "first long, at long, part binary")
    # at most piece + 2 * flank letters
    joined = slices.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("s"))
    body = F.expr("aggregate(s, cast('' as binary), (a, x) -> concat(a, x.part))")
    lead = (F.col("first") - F.element_at("s", 1)["at"]).cast("int")
    whole = joined.select(F.lit(0).cast("long").alias("seq_idx"), "first", lead.alias("lead"), body.alias("body"))
    # a piece that only flanks reach has no letters of its own
    own = F.least(F.lit(piece), F.octet_length("body") - F.col("lead")).cast("int")
    return whole.select("seq_idx", "first", "lead", own.alias("own"), "body").where("own > 0")


def assigned(hits: DataFrame, offsets: DataFrame, k: int, *, metric: str = "edit", trim_cost: bool = True) -> DataFrame:
    """(read_id, strand, seq_idx, begin, end, distance, trimmed): hits of the text of all, by the sequence that each lies in.

    A hit that crosses the end of its sequence is dropped with Hamming distances. With edit distances it is trimmed: if at most
    k letters stand before that end, it goes to the next sequence and begins there; else, if at most k stand after it, it ends there.
    Trimmed letters count as errors with trim_cost, and a hit that has more than k then is dropped; without trim_cost
    its distance stays. A hit that would keep no letter is dropped. Empty sequences hold nothing and are passed over.
    """
    seqs = offsets.where("len > 0").select("seq_idx", F.col("start_pos").alias("_start"), (F.col("start_pos") + F.col("len")).alias("_end"))
    placed = within(hits.select("read_id", "strand", "begin", "end", "distance"), F.col("begin"), seqs, "_start", "_end")
    inside = placed.where("end <= _end").select("read_id", "strand", "seq_idx", (F.col("begin") - F.col("_start")).alias("begin"), (F.col("end") - F.col("_start")).alias("end"), "distance", F.lit(False).alias("trimmed"))
    if metric == "hamming":
        return inside
    crossing = placed.where("end > _end").withColumn("_before", F.col("_end") - F.col("begin"))
    forward = crossing.where(F.col("_before") <= k).drop("seq_idx", "_start").withColumnRenamed("_end", "_next")
    forward = within(forward, F.col("_next"), seqs, "_start", "_end").withColumn("_from", F.col("_start")).withColumn("_to", F.least("end", "_end"))
    back = crossing.where((F.col("_before") > k) & (F.col("end") - F.col("_end") <= k)).withColumn("_from", F.col("begin")).withColumn("_to", F.col("_end"))
    names = ("read_id", "strand", "seq_idx", "begin", "end", "distance", "_start", "_from", "_to")
    cut = forward.select(*names).unionByName(back.select(*names))
    lost = (F.col("end") - F.col("begin")) - (F.col("_to") - F.col("_from"))
    distance = F.col("distance") + lost if trim_cost else F.col("distance")
    cut = cut.where("_to > _from").withColumn("_distance", distance).where(F.col("_distance") <= k)
    return inside.unionByName(cut.select("read_id", "strand", "seq_idx", (F.col("_from") - F.col("_start")).alias("begin"), (F.col("_to") - F.col("_start")).alias("end"), F.col("_distance").alias("distance"), F.lit(True).alias("trimmed")))


def trimmed_match(reads: DataFrame, refs: DataFrame, k: int, *, metric: str = "edit", trim_cost: bool = True, piece: int = scan.PIECE) -> DataFrame:
    """Hits of reads(read_id, seq) of at most scan.MOST_LETTERS letters in the text of all references, each by its sequence, see assigned.

    With edit distances: for every start the least distance, if at most k, and the shortest string that has it. Rows that trimming makes
    equal are one.
    """
    letters, longest = reads.agg(F.sum(F.length("seq")), F.max(F.length("seq"))).first()
    if (letters or 0) > scan.MOST_LETTERS:
        raise ValueError(f"reads have more than {scan.MOST_LETTERS} letters: map them in groups")
    offsets = written(sequence_offsets(refs), "offsets")
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    hits = scan.match_pieces(text_of_all(refs, offsets, (longest or 0) + k, piece), rows, k, metric)
    return assigned(hits, offsets, k, metric=metric, trim_cost=trim_cost).distinct()


# phi by intervals ---------------------------------------------------------------------------------


def phi_intervals(runs: DataFrame) -> DataFrame:
    """(text_id, input, upto, output): phi maps the text positions input to upto - 1 of a text to output and what follows it.

    From bwt.runs: a run's first sample is where an interval begins, and the sample before it in the order of suffixes, the last one of
    the run before (of the last run, for the first), is where it leads. Position 0 begins an interval, as the end of the text
    stands alone before it. A row for each run in place of one for each position.
    """
    own = Window.partitionBy("text_id")
    before = F.coalesce(F.lag("last_sa").over(own.orderBy("run")), F.max_by("last_sa", "run").over(own))
    mapped = runs.withColumn("output", before)
    n = F.sum("length").over(own)
    upto = F.coalesce(F.lead("first_sa").over(own.orderBy("first_sa")), n)
    return mapped.select("text_id", F.col("first_sa").alias("input"), upto.alias("upto"), "output")


def locate_by_phi(toeholds: DataFrame, intervals: DataFrame, plcp: DataFrame, length: int, *, steps: int = 4) -> DataFrame:
    """(text_id, pattern, pos): all places of each pattern of length letters, from the place of its last suffix.

    phi leads from a suffix to the one before it in order; while they have length letters in common (plcp), that one begins with the
    pattern too. Each round takes steps steps for the patterns that still go on and is written, so that lineage ends; rounds follow the
    most frequent pattern. toeholds: (text_id, pattern, toehold).
    """
    found = [written(toeholds.select("text_id", "pattern", F.col("toehold").alias("pos")), "located")]
    common = plcp.select(F.col("text_id").alias("_text"), F.col("pos").alias("_pos"), "plcp")
    while True:
        state, made = found[-1] if len(found) == 1 else found[-1].where(f"step = {steps - 1}").drop("step"), None
        for step in range(steps):
            going = state.join(common, (F.col("text_id") == F.col("_text")) & (F.col("pos") == F.col("_pos"))).where(F.col("plcp") >= length).drop("_text", "_pos", "plcp")
            moved = within(going, F.col("pos"), intervals, "input", "upto", by=("text_id",))
            state = moved.select("text_id", "pattern", (F.col("output") + F.col("pos") - F.col("input")).alias("pos"))
            one = state.withColumn("step", F.lit(step))
            made = one if made is None else made.unionByName(one)
        made = written(made, "located")
        if made.isEmpty():
            break
        found.append(made)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more.drop("step"))
    return out
