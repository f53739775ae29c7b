"""The registered queries over the driver's tables, and their SQL.

References are the documents and reads the benchmark texts, in upper case without other letters
than A, C, G and T. Suffix arrays and what follows from them are per benchmark text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import sequence
from strandwise.operators import bwt, growing, intervals, long_text, matching, reporting, scan, schemes, searching, seed_index
from strandwise.sources import sequences
from strandwise.sources.storage import new_path, written

GRAM = 3


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    named = docs.select(F.col("doc_id").alias("seq_idx"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("seq"))
    return sequence.with_acgt(named, "seq")


def ref_size(spark: SparkSession, sf_dir: str) -> scan.Measured:
    """Bounds from the documents, whose texts need not be masked for them."""
    return scan.measured(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_idx"), F.col("text").alias("seq")))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("read_id"), sequence.keep_acgt(F.col("text")).alias("seq"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), sequence.keep_acgt(F.col("text")).alias("text"))


def _long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long") if t == "int" else F.col(c) for c, t in df.dtypes))


def _normalize_refs(spark, sf):
    s = ref_seqs(spark, sf)
    return s.withColumn("len", F.length("seq").cast("long"))


def _masked_reads(spark, sf):
    return _table(spark, sf, "benchmark").select("item_id", sequence.mask_ambiguous(F.col("text")).alias("seq"), sequence.contains_ambiguous(sequence.ascii_upper(F.col("text"))).alias("ambiguous"))


def _revcomp_reads(spark, sf):
    return reads(spark, sf).select("read_id", sequence.revcomp(F.col("seq")).alias("rc"))


def _char_histogram(spark, sf):
    letters = matching.kmers(matching.tiles(ref_seqs(spark, sf), 0), [1])
    n = letters.groupBy(F.col("kmer").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("smaller", F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _kmer_table(spark, sf):
    return scan.kmer_counts(ref_seqs(spark, sf), 10)


def _kmer_lookup(spark, sf):
    seeds = reads(spark, sf).where(F.length("seq") >= 10).select("read_id", F.substring("seq", 1, 10).alias("kmer"))
    found = matching.kmers(matching.tiles(ref_seqs(spark, sf), 10), [10])
    return seeds.join(found, "kmer").select("read_id", "kmer", "seq_idx", "pos")


def _seq_offsets(spark, sf):
    return intervals.sequence_offsets(ref_seqs(spark, sf))


def _locate(spark, sf):
    """Global positions of exact hits back to sequences: the interval that holds each, by bins."""
    starts = written(_seq_offsets(spark, sf), "offsets")
    hits = _exact_both(spark, sf).join(starts, "seq_idx").select((F.col("begin") + F.col("start_pos")).alias("global_pos")).distinct()
    found = intervals.within(hits, F.col("global_pos"), starts.withColumn("upto", F.col("start_pos") + F.col("len")), "start_pos", "upto")
    return found.select("global_pos", "seq_idx", (F.col("global_pos") - F.col("start_pos")).alias("begin"))


def _index(spark, sf):
    """An index of the references, built for this query in the shared folder."""
    return seed_index.build(ref_seqs(spark, sf), new_path(spark, "index"), seed=6)


def _index_kmers(spark, sf):
    """Numbers of k-mers as the index holds them, with their counts and first places."""
    return _index(spark, sf).kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq_idx", "pos")).alias("f")).select("kmer", "n", "f.seq_idx", "f.pos")


def _indexed(k, metric):
    """Reads joined with the index, whatever their number."""
    return lambda spark, sf: seed_index.match(reads(spark, sf), _index(spark, sf), k, metric, most_letters=0)


def _grown(k, metric):
    """Parts that grow by the counts of the references' windows."""

    def query(spark, sf):
        own = reads(spark, sf)
        most = matching.longest(own) + k
        return growing.match(own, written(scan.pieces(ref_seqs(spark, sf), most, most), "pieces"), k, metric)

    return query


def _lengths(spark, sf):
    """(m, reads): how many reads have each length."""
    return reads(spark, sf).groupBy(F.length("seq").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("reads"))


def _schemes(spark, sf):
    """Every search, and how many reads have a letter for each of its parts."""
    few = F.broadcast(schemes.scheme_table(spark))
    counted = _lengths(spark, sf).crossJoin(few).groupBy("scheme", "k", "search_idx", "pi", "lower", "upper").agg(F.coalesce(F.sum(F.when(F.col("m") >= F.size("pi"), F.col("reads"))), F.lit(0)).alias("n_reads"))
    return counted.select("scheme", "k", "search_idx", *(F.concat_ws(",", c).alias(c) for c in ("pi", "lower", "upper")), "n_reads")


def _scheme_coverage(spark, sf):
    """What each scheme covers, and how many reads it can search."""
    table = schemes.scheme_table(spark)
    parts = table.groupBy("scheme", "k").agg(F.max(F.size("pi")).alias("parts"))
    can = _lengths(spark, sf).crossJoin(F.broadcast(parts)).groupBy("scheme", "k").agg(F.coalesce(F.sum(F.when(F.col("m") >= F.col("parts"), F.col("reads"))), F.lit(0)).alias("n_reads"))
    return schemes.scheme_coverage(table).join(can, ["scheme", "k"])


def _critical_parts(spark, sf):
    """Where each scheme's critical part lies in each read."""
    table = schemes.scheme_table(spark)
    few = schemes.critical_parts(table).join(table.groupBy("scheme", "k").agg(F.max(F.size("pi")).alias("parts")), ["scheme", "k"])
    size, at = F.length("seq"), F.col("critical_part")
    each = reads(spark, sf).crossJoin(F.broadcast(few))
    return each.select("read_id", "scheme", "k", "critical_part", *(F.floor(x * size / F.col("parts")).cast("long").alias(n) for n, x in (("begin", at), ("end", at + 1))))


def _directions(spark, sf):
    """Directions of every search, and how many letters of all reads it goes through to the right and to the left behind its first part."""
    table = schemes.scheme_table(spark)
    letters = lambda sign: F.expr(f"aggregate(filter(sequence(2, size(pi)), n -> n <= size(pi) AND n > 1 AND pi[n - 1] {sign} pi[n - 2]), 0L, (a, n) -> a + (pi[n - 1] + 1) * m div size(pi) - pi[n - 1] * m div size(pi))")
    went = _lengths(spark, sf).crossJoin(F.broadcast(table)).groupBy("scheme", "k", "search_idx")
    went = went.agg(F.sum(letters(">") * F.col("reads")).alias("forward"), F.sum(letters("<") * F.col("reads")).alias("backward"))
    return schemes.directions(table).join(went, ["scheme", "k", "search_idx"])


def _default_partitions(spark, sf):
    """Where the parts of each read start to grow, for 2 to 14 parts, and their weights."""
    few = F.broadcast(schemes.default_partitions(spark))
    each = reads(spark, sf).crossJoin(few).where(F.length("seq") >= F.col("parts"))
    return each.select("read_id", "parts", "part", "seed", "weight", F.floor(F.col("seed") * F.length("seq")).cast("long").alias("place"))


STRATEGIES = ("kuch1", "kuch2", "kianfar", "01*0", "pigeon", "minU")


def _searched(k, strategy):
    """By the seeds of a search scheme."""

    def query(spark, sf):
        own = reads(spark, sf)
        most = matching.longest(own) + k
        size = ref_size(spark, sf)
        return searching.match(own, scan.pieces(ref_seqs(spark, sf), most, most, size.letters), k, strategy, alone=size.alone)

    return query


def _strategy_costs(spark, sf):
    pieces = written(scan.pieces(ref_seqs(spark, sf), 0, scan.LONGEST_SEED), "pieces")
    return searching.strategy_costs(reads(spark, sf), pieces, 2, STRATEGIES)


def _fasta_references(spark, sf):
    """References as FASTA files and back, in small ranges of bytes."""
    path = new_path(spark, "fasta")
    sequences.write_fasta(ref_seqs(spark, sf), path)
    return sequences.read_reference_fasta(spark, path, range_bytes=1 << 16, kind="fasta")


def _fastq_reads(spark, sf):
    """Reads as FASTQ files and back, each with the read before it in the input: order is kept."""
    path = new_path(spark, "fastq")
    own = reads(spark, sf)
    sequences.write_fastq(own.withColumn("qual", F.translate("seq", "ACGT", "@+>I")), path)
    back = sequences.read_fastq(spark, path, with_place=True, range_bytes=1 << 10, kind="fastq")
    number = intervals.running_sum(back.withColumn("one", F.lit(1).cast("long")), "at", "one", "number")
    return number.select("number", "read_id", "seq", "qual")


def _trimmed(cost):
    return lambda spark, sf: intervals.trimmed_match(reads(spark, sf), ref_seqs(spark, sf), 1, trim_cost=cost)


def _phi_intervals(spark, sf):
    return intervals.phi_intervals(bwt.runs(bwt.bwt(bwt.suffix_array(texts(spark, sf)))))


def _locate_by_phi(spark, sf):
    own = texts(spark, sf)
    sa = written(bwt.suffix_array(own), "suffixes")
    toeholds = bwt.toeholds(_backward(spark, sf), sa)
    steps = written(intervals.phi_intervals(bwt.runs(bwt.bwt(sa))), "phi")
    return intervals.locate_by_phi(toeholds, steps, written(bwt.plcp(own, sa), "plcp"), GRAM)


def _long_suffix_array(spark, sf):
    """All texts side by side as one."""
    own = texts(spark, sf).select(F.col("text_id").alias("seq_idx"), F.col("text").alias("seq"))
    offsets = written(intervals.sequence_offsets(own), "offsets")
    letters = offsets.agg(F.sum("len")).first()[0] or 0
    return long_text.suffix_array(intervals.text_of_all(own, offsets, long_text.FIRST), letters)


def _exact_both(spark, sf):
    return matching.exact_match(reads(spark, sf), ref_seqs(spark, sf))


def _exact_forward(spark, sf):
    return _exact_both(spark, sf).where("strand = 'FW'")


def _hamming(k):
    return lambda spark, sf: matching.hamming_match(reads(spark, sf), ref_seqs(spark, sf), k, size=ref_size(spark, sf))


def _edit_starts(spark, sf):
    return matching.edit_starts(reads(spark, sf), ref_seqs(spark, sf), 1)


def _edit(k):
    return lambda spark, sf: matching.edit_match(reads(spark, sf), ref_seqs(spark, sf), k, size=ref_size(spark, sf))


def _best(beyond):
    def query(spark, sf):
        refs, every = ref_seqs(spark, sf), reads(spark, sf)
        most = matching.longest(every) + 2
        cut = written(scan.pieces(refs, most, most), "pieces")  # once for all rounds
        return matching.best_match(every, 2, beyond, "hamming", lambda own, k: matching.found_in(own, refs, cut, k, "hamming"))

    return query


def _best_edit(spark, sf):
    """From an index, in rounds."""
    index = _index(spark, sf)
    return matching.best_match(reads(spark, sf), 2, 0, "edit", lambda own, k: seed_index.found(own, index, k, "edit"))


def _ranked(spark, sf):
    r = reporting.ranked(_hamming(1)(spark, sf))
    return r.select("read_id", "seq_idx", "begin", "strand", "distance", "rank", "n_best", "mapq", sequence.sam_flag(F.col("strand"), F.col("rank") == 1).alias("flag"))


def _report(f, **options):
    def query(spark, sf):
        own, refs = reads(spark, sf), ref_seqs(spark, sf)
        return f(matching.hamming_match(own, refs, 1, size=ref_size(spark, sf)), own, refs, **options)

    return query


def _parts(k):
    return lambda spark, sf: _long(matching.uniform_parts(reads(spark, sf).withColumnRenamed("seq", "pattern"), k + 1).drop("pattern"))


STATIC_BEGINS = [0.25, 0.5, 0.8]


def _static_parts(spark, sf):
    return _long(matching.static_parts(reads(spark, sf).withColumnRenamed("seq", "pattern"), STATIC_BEGINS).drop("pattern"))


def _of_sa(f):
    return lambda spark, sf: f(bwt.suffix_array(texts(spark, sf)))


def _backward(spark, sf):
    own = texts(spark, sf)
    patterns = matching.kmers(matching.tiles(own.select(F.col("text_id").alias("seq_idx"), F.col("text").alias("seq")), GRAM), [GRAM])
    return bwt.backward_search(bwt.bwt(bwt.suffix_array(own)), patterns.select(F.col("seq_idx").alias("text_id"), F.col("kmer").alias("pattern")).distinct(), GRAM)


def _selective_seeds(spark, sf):
    return matching.selective_seeds(matching.strands(reads(spark, sf)), matching.tiles(ref_seqs(spark, sf), 8), 1, 6)


def _locate_patterns(spark, sf):
    return bwt.locate(_backward(spark, sf), bwt.suffix_array(texts(spark, sf)))


def _ranges(f):
    """f of the ranges of patterns, the transform and the suffix array."""

    def query(spark, sf):
        sa = bwt.suffix_array(texts(spark, sf))
        return f(_backward(spark, sf), bwt.bwt(sa), sa)

    return query


def _bidirectional(spark, sf):
    return bwt.bidirectional_search(bwt.bwt(bwt.suffix_array(texts(spark, sf))), _backward(spark, sf).select("text_id", "pattern"), GRAM)


def _kmer_rolls(spark, sf):
    r = reads(spark, sf).where(F.length("seq") > 10).select("read_id", sequence.pack_kmer(F.substring("seq", 2, 10)).alias("kmer"), F.substring("seq", 12, 1).alias("after"), F.substring("seq", 1, 1).alias("before"))
    kmer = F.col("kmer")
    return r.select("read_id", "kmer", F.when(F.col("after") != "", sequence.push_right(kmer, F.col("after"), 10)).alias("right"), sequence.push_left(kmer, F.col("before"), 10).alias("left"), sequence.revcomp_kmer(kmer, 10).alias("rc"))


def _alphabet(spark, sf):
    letters = _masked_reads(spark, sf).select(F.explode(F.split("seq", "")).alias("c")).where("c <> ''").distinct()
    return letters.select("c", sequence.letter_code(F.col("c")).alias("code")).withColumn("letter", sequence.code_letter(F.col("code")))


def _seed_guard(spark, sf):
    return matching.seed_guard(reads(spark, sf).withColumnRenamed("seq", "pattern"), 20)


def _part_to_grow(spark, sf):
    widths = matching.kmers(matching.tiles(ref_seqs(spark, sf), 4), [4]).groupBy("kmer").agg(F.count(F.lit(1)).alias("occurrences"))
    return matching.part_to_grow(matching.uniform_parts(matching.strands(reads(spark, sf)), 3), widths, schemes.part_weights(3), 4)


def _planned_searches(spark, sf):
    return matching.planned_searches(matching.strands(reads(spark, sf)), schemes.scheme_table(spark).where("scheme = 'kuch1' AND k = 2"))


QUERIES = {
    "normalize_refs": _normalize_refs,
    "masked_reads": _masked_reads,
    "revcomp_reads": _revcomp_reads,
    "char_histogram": _char_histogram,
    "kmer_table": _kmer_table,
    "kmer_lookup": _kmer_lookup,
    "seq_offsets": _seq_offsets,
    "locate_asof": _locate,
    "exact_match": _exact_forward,
    "exact_both_strands": _exact_both,
    "hamming_k1": _hamming(1),
    "hamming_k2": _hamming(2),
    "edit_starts_k1": _edit_starts,
    "cluster_centres": lambda spark, sf: matching.cluster_centres(_edit_starts(spark, sf)),
    "selective_seeds": _selective_seeds,
    "edit_k1": _edit(1),
    "edit_k2": _edit(2),
    "best_stratum": _best(0),
    "best_plus_x": _best(1),
    "best_edit": _best_edit,
    "mapq_flags": _ranked,
    "sam_records": _report(reporting.sam_records),
    "xa_records": _report(reporting.xa_records),
    "rhs_records": _report(reporting.rhs_records),
    "unmapped_reads": lambda spark, sf: reads(spark, sf).join(_hamming(1)(spark, sf).select("read_id").distinct(), "read_id", "left_anti"),
    "mapping_stats": lambda spark, sf: reporting.mapping_stats(_hamming(1)(spark, sf), reads(spark, sf)),
    "uniform_parts": _parts(2),
    "static_parts": _static_parts,
    "schemes": _schemes,
    "scheme_coverage": _scheme_coverage,
    "scheme_critical_part": _critical_parts,
    "suffix_array": _of_sa(lambda sa: sa),
    "bwt": _of_sa(lambda sa: bwt.bwt(sa).select("text_id", "i", "b")),
    "bwt_runs": _of_sa(lambda sa: bwt.runs(bwt.bwt(sa)).select("text_id", "run", "b", "begin", "length")),
    "lf_mapping": _of_sa(lambda sa: bwt.lf_mapping(bwt.bwt(sa))),
    "sa_samples": _of_sa(lambda sa: bwt.runs(bwt.bwt(sa)).select("text_id", "run", "first_sa", "last_sa")),
    "phi": _of_sa(bwt.phi),
    "plcp": lambda spark, sf: bwt.plcp(texts(spark, sf), bwt.suffix_array(texts(spark, sf))),
    "backward_search": _backward,
    "locate_patterns": _locate_patterns,
    "run_outputs": _of_sa(lambda sa: bwt.run_outputs(bwt.bwt(sa))),
    "sample_before": _of_sa(lambda sa: bwt.sample_before(bwt.bwt(sa))),
    "sa_permutation": _of_sa(bwt.is_permutation),
    "reverse_bwt": lambda spark, sf: bwt.reverse_bwt(texts(spark, sf)),
    "character_ranges": _of_sa(bwt.character_ranges),
    "rank_select": _of_sa(lambda sa: bwt.rank_select(bwt.bwt(sa))),
    "extend_alphabet": _ranges(lambda ranges, transformed, sa: bwt.extend_alphabet(ranges, transformed)),
    "bidirectional_search": _bidirectional,
    "toeholds": _ranges(lambda ranges, transformed, sa: bwt.toeholds(ranges, sa)),
    "kmer_rolls": _kmer_rolls,
    "alphabet_index": _alphabet,
    "seed_guard": _seed_guard,
    "part_to_grow": _part_to_grow,
    "planned_searches": _planned_searches,
    "scheme_directions": _directions,
    "default_partitions": _default_partitions,
    "index_kmers": _index_kmers,
    "indexed_exact": _indexed(0, "hamming"),
    "indexed_hamming_k1": _indexed(1, "hamming"),
    "indexed_edit_k1": _indexed(1, "edit"),
    "grown_hamming_k2": _grown(2, "hamming"),
    "grown_edit_k1": _grown(1, "edit"),
    "scheme_hamming_k2": _searched(2, "kuch1"),
    "scheme_hamming_k3": _searched(3, "minU"),
    "strategy_costs": _strategy_costs,
    "fasta_references": _fasta_references,
    "fastq_reads": _fastq_reads,
    "trimmed_hits": _trimmed(True),
    "trimmed_hits_free": _trimmed(False),
    "phi_intervals": _phi_intervals,
    "locate_by_phi": _locate_by_phi,
    "long_suffix_array": _long_suffix_array,
    "hits_median": lambda spark, sf: reporting.hits_median(_hamming(1)(spark, sf)),
}

# SQL ------------------------------------------------------------------------------------------

_SEQS = """
refs AS (SELECT doc_id AS seq_idx, 'doc' || doc_id AS name, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', '', 'g') AS seq FROM documents),
reads AS (SELECT 'r' || item_id AS read_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', '', 'g') AS seq FROM benchmark),
pats AS (SELECT read_id, 'FW' AS strand, seq AS p FROM reads WHERE seq <> '' UNION ALL SELECT read_id, 'RC', reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads WHERE seq <> '')"""


def _windows(n: int) -> str:
    return f"w AS (SELECT seq_idx, seq, unnest(range(length(seq) - {n} + 1))::BIGINT AS pos FROM refs WHERE length(seq) >= {n}), km AS (SELECT *, substr(seq, pos + 1, {n}) AS kmer FROM w)"


def _cand(k: int, n: int) -> str:
    """Where the first letters of a part stand: n, or as many as each part of the pattern has. Windows of all lengths that occur are made."""
    return f"""sized AS (SELECT *, least({n}, length(p) // {k + 1}) AS n FROM pats),
km AS (SELECT seq_idx, seq, n, pos, substr(seq, pos + 1, n) AS kmer FROM (SELECT seq_idx, seq, n, unnest(range(length(seq) - n + 1))::BIGINT AS pos FROM refs, (SELECT DISTINCT n FROM sized) WHERE length(seq) >= n)),
seeds AS (SELECT read_id, strand, p, b, n, substr(p, b + 1, n) AS kmer FROM (SELECT *, unnest([{", ".join(f"(length(p) * {i}) // {k + 1}" for i in range(k + 1))}]) AS b FROM sized)),
cand AS (SELECT DISTINCT read_id, strand, p, seq_idx, seq, pos - b AS begin FROM seeds JOIN km USING (n, kmer))"""


def _hits(k: int) -> str:
    """Hamming hits; seeds of 15 // (k + 1) letters, or of as many as the parts of shorter reads have."""
    return f"""{_SEQS}, {_cand(k, 15 // (k + 1))},
hits AS (SELECT read_id, min(strand) AS strand, seq_idx, begin, begin + length(p) AS "end", d AS distance FROM
  (SELECT *, hamming(p, substr(seq, begin + 1, length(p)))::BIGINT AS d FROM cand WHERE begin >= 0 AND begin + length(p) <= length(seq)) WHERE d <= {k} GROUP BY ALL)""".replace(
        "GROUP BY ALL", "GROUP BY read_id, seq_idx, begin, length(p), d"
    )


_EXACT = f"""{_SEQS}, {_cand(0, 15)},
exact AS (SELECT read_id, strand, seq_idx, begin, begin + length(p) AS "end", 0::BIGINT AS distance FROM cand WHERE substr(seq, begin + 1, length(p)) = p)"""

_HIT = 'read_id, strand, seq_idx, begin, "end", distance'


def _edit_sql(k: int, sequences: str = "") -> str:
    widths = ", ".join(f"({w})" for w in range(-k, k + 1))
    return f"""{sequences or _SEQS}, {_cand(k, 15 // (k + 1))},
near AS (SELECT DISTINCT read_id, strand, p, seq_idx, seq, begin + s AS begin FROM cand, (VALUES {widths}) AS v(s) WHERE begin + s BETWEEN 0 AND length(seq) - 1),
each AS (SELECT read_id, strand, seq_idx, begin, length(p) + x AS width, levenshtein(p, substr(seq, begin + 1, (length(p) + x)::BIGINT))::BIGINT AS d
  FROM near, (VALUES {widths}) AS v(x) WHERE length(p) + x > 0 AND begin + length(p) + x <= length(seq)),
starts AS (SELECT read_id, strand, seq_idx, begin, begin + (min(struct_pack(d := d, width := width))).width AS "end", min(d) AS distance FROM each WHERE d <= {k} GROUP BY read_id, strand, seq_idx, begin)"""


def _trimmed_sql(k: int, cost: bool) -> str:
    """References with what follows them, 100 letters of the next 60 at most; hits that begin in the reference."""
    seqs = _SEQS.replace("refs AS", "own AS", 1)
    more = "coalesce(left(string_agg(seq, '') OVER (ORDER BY seq_idx ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING), 100), '')"
    seqs += f""", full_ AS (SELECT *, length(seq)::BIGINT AS len, lead(seq_idx) OVER o AS next_idx, lead(length(seq)) OVER o AS next_len FROM own WHERE seq <> '' WINDOW o AS (ORDER BY seq_idx)),
refs AS (SELECT seq_idx, name, seq || {more} AS seq FROM full_)"""
    lost = f"distance + {'(\"end\" - begin) - (t - f)' if cost else '0'}"
    return f"""WITH {_edit_sql(k, seqs)},
placed AS (SELECT s.*, len, next_idx, next_len FROM starts s JOIN full_ USING (seq_idx) WHERE begin < len),
cut AS (SELECT *, CASE WHEN len - begin <= {k} THEN len ELSE begin END AS f, CASE WHEN len - begin <= {k} THEN least("end", len + next_len) ELSE len END AS t, len - begin <= {k} AS on_
  FROM placed WHERE "end" > len AND (len - begin <= {k} OR "end" - len <= {k}))
SELECT read_id, strand, seq_idx, begin, "end", distance, false AS trimmed FROM placed WHERE "end" <= len
UNION SELECT read_id, strand, CASE WHEN on_ THEN next_idx ELSE seq_idx END, CASE WHEN on_ THEN f - len ELSE f END, CASE WHEN on_ THEN t - len ELSE t END, {lost}, true FROM cut WHERE t > f AND {lost} <= {k}"""


def _costs_sql(k: int) -> str:
    """Windows of each seed's length that are within its errors of it; every window is met with every different seed of its length."""
    wanted = [(s, len(schemes.build(s, k)[0].order), *x) for s in STRATEGIES for x in searching.stretches(schemes.build(s, k))]
    values = ", ".join(f"('{s}', {p}, {a}, {b}, {e})" for s, p, a, b, e in wanted)
    return f"""WITH {_SEQS}, st(strategy, parts, a, b, e) AS (VALUES {values}),
s AS (SELECT strategy, e, substr(p, (a * length(p)) // parts + 1, least({scan.LONGEST_SEED}, ((b + 1) * length(p)) // parts - (a * length(p)) // parts)) AS seed FROM pats, st WHERE length(p) >= parts),
u AS (SELECT DISTINCT seed, e, length(seed) AS n FROM s),
w AS (SELECT n, substr(seq, pos + 1, n) AS kmer, count(*) AS c FROM (SELECT seq, n, unnest(range(length(seq) - n + 1)) AS pos FROM refs, (SELECT DISTINCT n FROM u) WHERE length(seq) >= n) GROUP BY ALL),
c AS (SELECT seed, e, sum(c) AS c FROM u JOIN w USING (n) WHERE hamming(seed, kmer) <= e GROUP BY seed, e)
SELECT strategy, count(*)::BIGINT AS seeds, coalesce(sum(c), 0)::BIGINT AS places FROM s LEFT JOIN c USING (seed, e) GROUP BY strategy"""


def _thinned(k: int) -> str:
    """The greedy filter as a fold over each read's sorted list: the last kept hit and those before it."""
    return f"""{_edit_sql(k)},
lists AS (SELECT read_id, seq_idx, list(struct_pack(b := begin, d := distance, w := "end" - begin, s := strand) ORDER BY begin, distance, "end" - begin, strand) AS l FROM starts GROUP BY read_id, seq_idx),
folded AS (SELECT read_id, seq_idx, list_reduce(list_transform(l, lambda x: [x]), lambda a, x:
    CASE WHEN x[1].b - a[-1].b > {2 * k} THEN list_concat(a, x)
         WHEN x[1].b = a[-1].b OR x[1].d > a[-1].d OR (x[1].d = a[-1].d AND x[1].w >= a[-1].w) THEN a
         ELSE list_concat(a[:-2], x) END) AS l FROM lists),
hits AS (SELECT read_id, h.s AS strand, seq_idx, h.b AS begin, h.b + h.w AS "end", h.d AS distance FROM (SELECT read_id, seq_idx, unnest(l) AS h FROM folded))"""


_RANKED = f"""{_hits(1)},
r1 AS (SELECT *, distance = min(distance) OVER (PARTITION BY read_id) AS is_best, row_number() OVER (PARTITION BY read_id ORDER BY distance, seq_idx, begin, "end", strand) AS rank FROM hits),
r2 AS (SELECT *, (sum(is_best::INT) OVER (PARTITION BY read_id))::BIGINT AS n_best FROM r1),
ranked AS (SELECT *, (CASE WHEN NOT is_best THEN 0 WHEN n_best = 1 THEN 60 ELSE round(-10 * log10(1 - 1 / n_best)) END)::BIGINT AS mapq,
  ((CASE WHEN strand = 'RC' THEN 16 ELSE 0 END) + (CASE WHEN rank = 1 THEN 0 ELSE 256 END))::BIGINT AS flag FROM r2)"""

_SUFFIXES = """
t AS (SELECT item_id AS text_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', '', 'g') || '$' AS text FROM benchmark),
s AS (SELECT text_id, text, length(text)::BIGINT AS n, unnest(range(length(text)))::BIGINT AS sa FROM t),
sa AS (SELECT text_id, text, n, sa, substr(text, sa + 1, 1) AS c, row_number() OVER (PARTITION BY text_id ORDER BY substr(text, sa + 1)) - 1 AS i FROM s),
bwt AS (SELECT *, substr(text, CASE WHEN sa = 0 THEN n ELSE sa END, 1) AS b FROM sa),
ch AS (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY text_id ORDER BY i) THEN 0 ELSE 1 END AS x FROM bwt),
runs AS (SELECT *, (sum(x) OVER (PARTITION BY text_id ORDER BY i) - 1)::BIGINT AS run FROM ch)"""


def _scheme_values() -> str:
    rows = ", ".join(f"('{s}', {k}, {n}, {a}, {b}, {c})" for s, k, n, a, b, c in schemes.scheme_rows())
    return f"sch(scheme, k, search_idx, pi, lower, upper) AS (VALUES {rows})"


ORACLES = {
    "normalize_refs": f"WITH {_SEQS} SELECT *, length(seq)::BIGINT AS len FROM refs",
    "masked_reads": "SELECT item_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g') AS seq, regexp_matches(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]') AS ambiguous FROM benchmark",
    "revcomp_reads": f"WITH {_SEQS} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads",
    "char_histogram": f"WITH {_SEQS}, n AS (SELECT c, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(seq, '')) AS c FROM refs) WHERE c <> '' GROUP BY c) SELECT c, n, (sum(n) OVER (ORDER BY c) - n)::BIGINT AS smaller FROM n",
    "kmer_table": f"WITH {_SEQS}, {_windows(10)}, g AS (SELECT kmer, count(*)::BIGINT AS n, min(struct_pack(s := seq_idx, p := pos)) AS f FROM km GROUP BY kmer) "
    "SELECT list_reduce(list_prepend(0::BIGINT, list_transform(string_split(translate(kmer, 'ACGT', '0123'), ''), lambda x: x::BIGINT)), lambda a, x: 4 * a + x) AS kmer, n, f.s AS seq_idx, f.p AS pos FROM g",
    "kmer_lookup": f"WITH {_SEQS}, {_windows(10)} SELECT read_id, kmer, seq_idx, pos FROM (SELECT read_id, substr(seq, 1, 10) AS kmer FROM reads WHERE length(seq) >= 10) JOIN km USING (kmer)",
    "seq_offsets": f"WITH {_SEQS} SELECT seq_idx, length(seq)::BIGINT AS len, (sum(length(seq)) OVER (ORDER BY seq_idx) - length(seq))::BIGINT AS start_pos FROM refs",
    "locate_asof": f"WITH {_EXACT}, o AS (SELECT seq_idx, length(seq) AS len, (sum(length(seq)) OVER (ORDER BY seq_idx) - length(seq))::BIGINT AS start_pos FROM refs), a AS (SELECT DISTINCT begin + start_pos AS global_pos FROM exact JOIN o USING (seq_idx)) SELECT global_pos, seq_idx, global_pos - start_pos AS begin FROM a JOIN o ON global_pos >= start_pos AND global_pos < start_pos + len",
    "exact_match": f"WITH {_EXACT} SELECT {_HIT} FROM exact WHERE strand = 'FW'",
    "exact_both_strands": f"WITH {_EXACT} SELECT {_HIT} FROM exact",
    "hamming_k1": f"WITH {_hits(1)} SELECT {_HIT} FROM hits",
    "hamming_k2": f"WITH {_hits(2)} SELECT {_HIT} FROM hits",
    "edit_starts_k1": f"WITH {_edit_sql(1)} SELECT {_HIT} FROM starts",
    "cluster_centres": f"""WITH {_edit_sql(1)}, n AS (SELECT s.*, l.distance AS l, r.distance AS r FROM starts s
  LEFT JOIN starts l ON (l.read_id, l.strand, l.seq_idx, l.begin) = (s.read_id, s.strand, s.seq_idx, s.begin - 1)
  LEFT JOIN starts r ON (r.read_id, r.strand, r.seq_idx, r.begin) = (s.read_id, s.strand, s.seq_idx, s.begin + 1))
  SELECT {_HIT} FROM n WHERE coalesce(l, distance) >= distance AND coalesce(r, distance) >= distance""",
    "selective_seeds": f"""WITH {_SEQS}, {_windows(6)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer),
  p AS (SELECT read_id, strand, p, part::BIGINT AS part, (part * length(p)) // 2 AS b, ((part + 1) * length(p)) // 2 AS e FROM pats, (VALUES (0), (1)) AS v(part)),
  a AS (SELECT *, unnest(range(b, e - 5)) AS at_ FROM p),
  k AS (SELECT *, substr(p, at_ + 1, 6) AS kmer FROM a),
  m AS (SELECT read_id, strand, part, min(struct_pack(n := coalesce(n, 0), at_ := at_, kmer := kmer)) AS m FROM k LEFT JOIN c USING (kmer) GROUP BY read_id, strand, part)
  SELECT read_id, strand, part, m.at_ AS begin, m.kmer AS kmer, m.n AS occurrences FROM m""",
    "edit_k1": f"WITH {_thinned(1)} SELECT {_HIT} FROM hits",
    "edit_k2": f"WITH {_thinned(2)} SELECT {_HIT} FROM hits",
    "best_stratum": f"WITH {_hits(2)} SELECT {_HIT} FROM hits QUALIFY distance = min(distance) OVER (PARTITION BY read_id)",
    "best_plus_x": f"WITH {_hits(2)} SELECT {_HIT} FROM hits QUALIFY distance <= min(distance) OVER (PARTITION BY read_id) + 1",
    "best_edit": f"WITH {_thinned(2)} SELECT {_HIT} FROM hits QUALIFY distance = min(distance) OVER (PARTITION BY read_id)",
    "mapq_flags": f"WITH {_RANKED} SELECT read_id, seq_idx, begin, strand, distance, rank, n_best, mapq, flag FROM ranked",
    "sam_records": f"""WITH {_RANKED} SELECT read_id AS qname, flag, name AS rname, begin + 1 AS pos, mapq, '*' AS cigar, '*' AS rnext, 0::BIGINT AS pnext, 0::BIGINT AS tlen,
  CASE WHEN rank > 1 THEN '*' WHEN strand = 'RC' THEN reverse(translate(reads.seq, 'ACGT', 'TGCA')) ELSE reads.seq END AS seq, '*' AS qual, distance AS as_i, distance AS nm_i
  FROM ranked JOIN refs USING (seq_idx) JOIN reads USING (read_id)
  UNION ALL SELECT read_id, 4, '*', 0, 0, '*', '*', 0, 0, CASE WHEN seq = '' THEN '*' ELSE seq END, '*', NULL, NULL FROM reads WHERE read_id NOT IN (SELECT read_id FROM hits)""",
    "xa_records": f"""WITH {_RANKED}, e AS (SELECT *, name || ',' || (CASE WHEN strand = 'RC' THEN '-' ELSE '+' END) || (begin + 1) || ',*,' || distance || ';' AS e FROM ranked JOIN refs USING (seq_idx)),
  a AS (SELECT read_id, max(n_best) AS n_best, count(*) AS n, coalesce(string_agg(e, '' ORDER BY rank) FILTER (rank > 1), '') AS xa FROM e GROUP BY read_id)
  SELECT read_id AS qname, name AS rname, begin + 1 AS pos, strand, distance AS nm_i, mapq, a.n_best - 1 AS x0, a.n - a.n_best AS x1, xa FROM e JOIN a USING (read_id) WHERE rank = 1""",
    "rhs_records": f"""WITH {_hits(1)}, p AS (SELECT DISTINCT read_id, seq_idx, name, distance FROM hits JOIN refs USING (seq_idx)),
  l AS (SELECT read_id, string_agg('(' || name || ',' || distance || ')', ';' ORDER BY distance, seq_idx) AS l FROM p GROUP BY read_id) SELECT read_id, read_id || chr(9) || coalesce(l, '*') AS line FROM reads LEFT JOIN l USING (read_id)""",
    "unmapped_reads": f"WITH {_hits(1)} SELECT read_id, seq FROM reads WHERE read_id NOT IN (SELECT read_id FROM hits)",
    "mapping_stats": f"""WITH {_hits(1)}, n AS (SELECT read_id, count(hits.begin) AS n FROM reads LEFT JOIN hits USING (read_id) GROUP BY read_id)
  SELECT count(*) AS n_reads, count(*) FILTER (n > 0) AS n_mapped, sum(n)::BIGINT AS n_hits, sum(n) / count(*) AS hits_per_read, (count(*) FILTER (n > 0)) * 100 / count(*) AS mapped_percent FROM n""",
    "uniform_parts": f"WITH {_SEQS} SELECT read_id, part::BIGINT AS part, (part * length(seq)) // 3 AS begin, ((part + 1) * length(seq)) // 3 AS \"end\" FROM reads, (VALUES (0), (1), (2)) AS v(part)",
    "static_parts": f"WITH {_SEQS} SELECT read_id, part::BIGINT AS part, floor(a * length(seq))::BIGINT AS begin, floor(b * length(seq))::BIGINT AS \"end\" FROM reads, (VALUES (0, 0::DOUBLE, 0.25::DOUBLE), (1, 0.25, 0.5), (2, 0.5, 0.8), (3, 0.8, 1)) AS v(part, a, b)",
    "schemes": f"WITH {_SEQS}, {_scheme_values()} SELECT (SELECT count(*) FROM reads WHERE length(seq) >= len(pi))::BIGINT AS n_reads, scheme, k::BIGINT AS k, search_idx::BIGINT AS search_idx, array_to_string(pi, ',') AS pi, array_to_string(lower, ',') AS lower, array_to_string(upper, ',') AS upper FROM sch",
    "scheme_coverage": f"""WITH RECURSIVE {_SEQS}, {_scheme_values()}, p AS (SELECT DISTINCT scheme, k::BIGINT AS k, len(pi) AS p FROM sch),
  d AS (SELECT scheme, k, p, []::BIGINT[] AS d, 0::BIGINT AS total FROM p
    UNION ALL SELECT scheme, k, p, list_append(d, e), total + e FROM (SELECT *, unnest(range(0, k - total + 1)) AS e FROM d WHERE len(d) < p)),
  m AS (SELECT scheme, d.k AS k, d, list_bool_and(list_transform(range(1, len(pi) + 1), lambda n: list_sum(list_transform(pi[1:n], lambda x: d[x + 1])) BETWEEN lower[n] AND upper[n])) AS good
    FROM d JOIN sch USING (scheme, k) WHERE len(d) = p)
  SELECT scheme, k, count(DISTINCT d) AS n_distributions, count(DISTINCT d) FILTER (good) AS n_covered,
    (SELECT count(*) FROM reads WHERE length(seq) >= max(len(m.d)))::BIGINT AS n_reads FROM m GROUP BY scheme, k""",
    "scheme_critical_part": f"""WITH {_SEQS}, {_scheme_values()}, c AS (SELECT scheme, k::BIGINT AS k, max(len(pi)) AS parts, (arg_min(pi[1], struct_pack(u := list_transform(upper, lambda x: -x), l := lower, i := search_idx)))::BIGINT AS critical_part FROM sch GROUP BY scheme, k)
  SELECT read_id, scheme, k, critical_part, (critical_part * length(seq)) // parts AS begin, ((critical_part + 1) * length(seq)) // parts AS "end" FROM reads, c""",
    "suffix_array": f"WITH {_SUFFIXES} SELECT text_id, i, sa, c, n FROM sa",
    "bwt": f"WITH {_SUFFIXES} SELECT text_id, i, b FROM bwt",
    "bwt_runs": f"WITH {_SUFFIXES} SELECT text_id, run, any_value(b) AS b, min(i) AS begin, count(*) AS length FROM runs GROUP BY text_id, run",
    "lf_mapping": f"WITH {_SUFFIXES} SELECT text_id, i, b, row_number() OVER (PARTITION BY text_id ORDER BY b, i) - 1 AS lf FROM bwt",
    "sa_samples": f"WITH {_SUFFIXES} SELECT text_id, run, arg_min(sa, i) AS first_sa, arg_max(sa, i) AS last_sa FROM runs GROUP BY text_id, run",
    "phi": f"WITH {_SUFFIXES} SELECT a.text_id, a.sa, b.sa AS phi, c.sa AS phi_inverse FROM sa a JOIN sa b ON a.text_id = b.text_id AND b.i = (a.i + a.n - 1) % a.n JOIN sa c ON a.text_id = c.text_id AND c.i = (a.i + 1) % a.n",
    "plcp": f"WITH {_SUFFIXES} SELECT a.text_id, a.sa AS pos, (SELECT coalesce(max(l), 0)::BIGINT FROM unnest(range(1, a.n - greatest(a.sa, b.sa))) AS u(l) WHERE substr(a.text, a.sa + 1, l) = substr(a.text, b.sa + 1, l)) AS plcp FROM sa a LEFT JOIN sa b ON a.text_id = b.text_id AND b.i = a.i - 1",
    "backward_search": f"WITH {_SUFFIXES} SELECT text_id, substr(text, sa + 1, {GRAM}) AS pattern, min(i) AS begin, max(i) + 1 AS \"end\" FROM sa WHERE sa + {GRAM} < n GROUP BY text_id, pattern",
    "locate_patterns": f"WITH {_SUFFIXES} SELECT text_id, substr(text, sa + 1, {GRAM}) AS pattern, sa AS pos FROM sa WHERE sa + {GRAM} < n",
    "run_outputs": f"""WITH {_SUFFIXES}, lf AS (SELECT text_id, i, row_number() OVER (PARTITION BY text_id ORDER BY b, i) - 1 AS lf FROM bwt),
  e AS (SELECT text_id, run, min(i) AS begin, max(i) AS last FROM runs GROUP BY text_id, run)
  SELECT e.text_id, e.run, lf AS output, o.run AS output_run FROM e JOIN lf ON lf.text_id = e.text_id AND lf.i = e.begin JOIN e o ON o.text_id = e.text_id AND lf BETWEEN o.begin AND o.last""",
    "sample_before": f"""WITH {_SUFFIXES}, f AS (SELECT text_id, arg_min(sa, i) AS s FROM runs GROUP BY text_id, run)
  SELECT text_id, sa AS pos, coalesce((SELECT max(s) FROM f WHERE f.text_id = sa.text_id AND s <= sa.sa), (SELECT max(s) FROM f WHERE f.text_id = sa.text_id)) AS sample FROM sa""",
    "sa_permutation": f"WITH {_SUFFIXES} SELECT text_id, min(sa) = 0 AND max(sa) = count(*) - 1 AND count(DISTINCT sa) = count(*) AS good FROM sa GROUP BY text_id",
    "reverse_bwt": f"""WITH {_SUFFIXES}, r AS (SELECT text_id, reverse(text[:-2]) || '$' AS text FROM t),
  q AS (SELECT text_id, text, unnest(range(length(text)))::BIGINT AS p FROM r)
  SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY substr(text, p + 1)) - 1 AS i, substr(text, CASE WHEN p = 0 THEN length(text) ELSE p END, 1) AS b FROM q""",
    "character_ranges": f"WITH {_SUFFIXES} SELECT text_id, c, min(i) AS begin, max(i) + 1 AS \"end\" FROM sa GROUP BY text_id, c",
    "rank_select": f"WITH {_SUFFIXES} SELECT text_id, i, b, (count(*) OVER (PARTITION BY text_id, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::BIGINT AS rank, min(i) OVER (PARTITION BY text_id, b ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM bwt",
    "extend_alphabet": f"WITH {_SUFFIXES} SELECT text_id, substr(text, sa + 1, {GRAM + 1}) AS pattern, min(i) AS begin, max(i) + 1 AS \"end\" FROM sa WHERE sa + {GRAM + 1} < n GROUP BY text_id, pattern",
    "bidirectional_search": f"""WITH {_SUFFIXES}, r AS (SELECT text_id, reverse(text[:-2]) || '$' AS text FROM t),
  q AS (SELECT text_id, text, unnest(range(length(text)))::BIGINT AS p FROM r),
  v AS (SELECT text_id, text, p, row_number() OVER (PARTITION BY text_id ORDER BY substr(text, p + 1)) - 1 AS i FROM q),
  f AS (SELECT text_id, substr(text, sa + 1, {GRAM}) AS pattern, min(i) AS begin, max(i) + 1 AS "end" FROM sa WHERE sa + {GRAM} < n GROUP BY text_id, pattern),
  g AS (SELECT text_id, reverse(substr(text, p + 1, {GRAM})) AS pattern, min(i) AS rev_begin, max(i) + 1 AS rev_end FROM v WHERE p + {GRAM} < length(text) GROUP BY text_id, pattern)
  SELECT * FROM f JOIN g USING (text_id, pattern)""",
    "toeholds": f"WITH {_SUFFIXES} SELECT text_id, substr(text, sa + 1, {GRAM}) AS pattern, arg_max(sa, i) AS toehold, count(*) AS occurrences FROM sa WHERE sa + {GRAM} < n GROUP BY text_id, pattern",
    "kmer_rolls": f"""WITH {_SEQS}, x AS (SELECT read_id, seq, unnest([1, 2, 3, 4]) AS which FROM reads WHERE length(seq) > 10),
  y AS (SELECT read_id, which, CASE which WHEN 1 THEN substr(seq, 2, 10) WHEN 2 THEN CASE WHEN length(seq) > 11 THEN substr(seq, 3, 10) END WHEN 3 THEN substr(seq, 1, 10) ELSE reverse(translate(substr(seq, 2, 10), 'ACGT', 'TGCA')) END AS w FROM x),
  z AS (SELECT read_id, which, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(translate(w, 'ACGT', '0123'), ''), lambda c: c::BIGINT)), lambda a, c: 4 * a + c) AS w FROM y WHERE w IS NOT NULL)
  SELECT read_id, max(w) FILTER (which = 1) AS kmer, max(w) FILTER (which = 2) AS "right", max(w) FILTER (which = 3) AS "left", max(w) FILTER (which = 4) AS rc FROM z GROUP BY read_id""",
    "alphabet_index": """WITH m AS (SELECT DISTINCT unnest(string_split(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g'), '')) AS c FROM benchmark)
  SELECT c, (strpos('ACGT', c) - 1)::BIGINT AS code, CASE WHEN strpos('ACGT', c) > 0 THEN c END AS letter FROM m WHERE c <> ''""",
    "seed_guard": f"WITH {_SEQS} SELECT read_id, seq AS pattern, length(seq) <= 20 AS naive FROM reads",
    "part_to_grow": f"""WITH {_SEQS}, {_windows(4)}, n AS (SELECT kmer, count(*)::BIGINT AS n FROM km GROUP BY kmer),
  s AS (SELECT read_id, strand, part::BIGINT AS part, weight, substr(p, (part * length(p)) // 3 + 1, 4) AS kmer FROM pats, (VALUES (0, 2), (1, 1), (2, 2)) AS v(part, weight)),
  m AS (SELECT read_id, strand, min(struct_pack(o := -coalesce(n, 0) * weight, part := part, width := coalesce(n, 0))) AS m FROM s LEFT JOIN n USING (kmer) GROUP BY read_id, strand)
  SELECT read_id, strand, m.part AS part, m.width AS width FROM m""",
    "planned_searches": f"""WITH {_SEQS}, {_scheme_values()}, f AS (SELECT search_idx::BIGINT AS search_idx, pi[1]::BIGINT AS part, len(pi) AS parts FROM sch WHERE scheme = 'kuch1' AND k = 2)
  SELECT read_id, strand, search_idx, part, (part * length(p)) // parts AS begin, ((part + 1) * length(p)) // parts AS "end" FROM pats, f""",
    "scheme_directions": f"""WITH {_SEQS}, {_scheme_values()}, g AS (SELECT scheme, k, search_idx, pi, seq, unnest(range(2, len(pi) + 1)) AS n FROM sch, reads),
  w AS (SELECT scheme, k, search_idx, pi[n] > pi[n - 1] AS f, ((pi[n] + 1) * length(seq)) // len(pi) - (pi[n] * length(seq)) // len(pi) AS x FROM g),
  l AS (SELECT scheme, k, search_idx, coalesce(sum(x) FILTER (f), 0)::BIGINT AS forward, coalesce(sum(x) FILTER (NOT f), 0)::BIGINT AS backward FROM w GROUP BY ALL),
  d AS (SELECT scheme, k, search_idx, list_transform(range(2, len(pi) + 1), lambda n: CASE WHEN pi[n] > pi[n - 1] THEN 'F' ELSE 'B' END) AS d FROM sch)
  SELECT scheme, k::BIGINT AS k, search_idx::BIGINT AS search_idx, array_to_string(d, '') AS directions, len(list_filter(range(2, len(d) + 1), lambda n: d[n] <> d[n - 1]))::BIGINT AS switches, coalesce(forward, 0) AS forward, coalesce(backward, 0) AS backward FROM d LEFT JOIN l USING (scheme, k, search_idx)""",
    "default_partitions": f"""WITH {_SEQS}, p AS (SELECT unnest(range(2, 15)) AS parts), e AS (SELECT parts, unnest(range(0, parts)) AS part FROM p)
  SELECT read_id, parts, part, part::DOUBLE / (parts - 1)::DOUBLE AS seed, (CASE WHEN part IN (0, parts - 1) THEN 2 ELSE 1 END)::BIGINT AS weight,
    floor(part::DOUBLE / (parts - 1)::DOUBLE * length(seq))::BIGINT AS place FROM e, reads WHERE length(seq) >= parts""",
    "index_kmers": f"WITH {_SEQS}, {_windows(6)} SELECT list_reduce(list_prepend(0::BIGINT, list_transform(string_split(translate(reverse(kmer), 'ACGT', '0123'), ''), lambda x: x::BIGINT)), lambda a, x: 5 * a + x) AS kmer, count(*)::BIGINT AS n, min(struct_pack(s := seq_idx, p := pos)).s AS seq_idx, min(struct_pack(s := seq_idx, p := pos)).p AS pos FROM km GROUP BY km.kmer",
    "indexed_exact": f"WITH {_EXACT} SELECT {_HIT} FROM exact",
    "indexed_hamming_k1": f"WITH {_hits(1)} SELECT {_HIT} FROM hits",
    "indexed_edit_k1": f"WITH {_thinned(1)} SELECT {_HIT} FROM hits",
    "grown_hamming_k2": f"WITH {_hits(2)} SELECT {_HIT} FROM hits",
    "grown_edit_k1": f"WITH {_thinned(1)} SELECT {_HIT} FROM hits",
    "scheme_hamming_k2": f"WITH {_hits(2)} SELECT {_HIT} FROM hits",
    "scheme_hamming_k3": f"WITH {_hits(3)} SELECT {_HIT} FROM hits",
    "strategy_costs": _costs_sql(2),
    "fasta_references": f"WITH {_SEQS} SELECT row_number() OVER (ORDER BY seq_idx) - 1 AS seq_idx, name, seq, length(seq)::BIGINT AS len FROM refs",
    "fastq_reads": f"WITH {_SEQS} SELECT row_number() OVER (ORDER BY read_id) - 1 AS number, read_id, seq, translate(seq, 'ACGT', '@+>I') AS qual FROM reads",
    "trimmed_hits": _trimmed_sql(1, True),
    "trimmed_hits_free": _trimmed_sql(1, False),
    "phi_intervals": f"""WITH {_SUFFIXES}, r AS (SELECT text_id, run, arg_min(sa, i) AS f, arg_max(sa, i) AS l, any_value(n) AS n FROM runs GROUP BY text_id, run)
  SELECT text_id, f AS input, coalesce(lead(f) OVER (PARTITION BY text_id ORDER BY f), n) AS upto,
    coalesce(lag(l) OVER (PARTITION BY text_id ORDER BY run), first_value(l) OVER (PARTITION BY text_id ORDER BY run DESC)) AS output FROM r""",
    "locate_by_phi": f"WITH {_SUFFIXES} SELECT text_id, substr(text, sa + 1, {GRAM}) AS pattern, sa AS pos FROM sa WHERE sa + {GRAM} < n",
    "long_suffix_array": f"WITH {_SUFFIXES}, w AS (SELECT string_agg(left(text, length(text) - 1), '' ORDER BY text_id) || '$' AS text FROM t), p AS (SELECT text, unnest(range(length(text)))::BIGINT AS sa FROM w) SELECT row_number() OVER (ORDER BY substr(text, sa + 1)) - 1 AS i, sa FROM p",
    "hits_median": f"WITH {_hits(1)}, n AS (SELECT read_id, count(*) AS n FROM hits GROUP BY read_id) SELECT count(*) AS n_mapped, median(n)::DOUBLE AS median_hits FROM n",
}
