"""Strata, primary hits, mapping quality, and the lines and statistics of a mapping run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import FLAG_SECONDARY, FLAG_UNMAPPED, mapq, sam_flag

PROGRAM = "strandwise"


def best_strata(hits: DataFrame, beyond: int = 0) -> DataFrame:
    """Hits within so many errors of their read's best."""
    best = F.min("distance").over(Window.partitionBy("read_id"))
    return hits.withColumn("_best", best).where(F.col("distance") <= F.col("_best") + beyond).drop("_best")


def ranked(hits: DataFrame) -> DataFrame:
    """hits with n_best (of its read's least distance), is_best, rank (1: primary) and mapq."""
    read = Window.partitionBy("read_id")
    order = read.orderBy("distance", "seq_idx", "begin", "end", "strand")
    least = F.min("distance").over(read)
    out = hits.withColumn("is_best", F.col("distance") == least).withColumn("rank", F.row_number().over(order).cast("long"))
    out = out.withColumn("n_best", F.sum(F.col("is_best").cast("long")).over(read))
    return out.withColumn("mapq", mapq(F.col("is_best"), F.col("n_best")))


def _or_star(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "*").otherwise(c)


def _with_reads(hits: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    named = ranked(hits).join(refs.select("seq_idx", "name"), "seq_idx")
    qual = F.col("qual") if "qual" in reads.columns else F.lit("")
    own = reads.select("read_id", F.col("seq").alias("read"), qual.alias("qual"))
    return named.join(own, "read_id")


def _unmapped(hits: DataFrame, reads: DataFrame) -> DataFrame:
    return reads.join(hits.select("read_id").distinct(), "read_id", "left_anti")


def sam_records(hits: DataFrame, reads: DataFrame, refs: DataFrame, *, unmapped: bool = True) -> DataFrame:
    """One row per alignment: the eleven SAM columns and as_i, nm_i. Only primary rows carry the sequence and quality."""
    rows = _with_reads(hits, reads, refs)
    primary, back = F.col("rank") == 1, F.col("strand") == "RC"
    seq = F.when(back, F.reverse(F.translate("read", "ACGT", "TGCA"))).otherwise(F.col("read"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    zero = F.lit(0).cast("long")
    mapped = rows.select(
        F.col("read_id").alias("qname"), sam_flag(F.col("strand"), primary).alias("flag"), F.col("name").alias("rname"), (F.col("begin") + 1).alias("pos"), "mapq", F.lit("*").alias("cigar"),
        F.lit("*").alias("rnext"), zero.alias("pnext"), zero.alias("tlen"), F.when(primary, seq).otherwise("*").alias("seq"), F.when(primary, _or_star(qual)).otherwise("*").alias("qual"), F.col("distance").alias("as_i"), F.col("distance").alias("nm_i"),
    )
    if not unmapped:
        return mapped
    qual = F.col("qual") if "qual" in reads.columns else F.lit("")
    star, none = F.lit("*"), F.lit(None).cast("long")
    return mapped.union(_unmapped(hits, reads).select("read_id", F.lit(FLAG_UNMAPPED).cast("long"), star, zero, zero, star, star, zero, zero, _or_star(F.col("seq")), _or_star(qual), none, none))


def _place(order: DataFrame | None, name: str) -> tuple[Column, DataFrame | None]:
    """The key by which lines of the read in column name stand, and (_of, _at) to join for it: input order if order(read_id, at) is given, else names."""
    if order is None:
        return F.col(name), None
    return F.lpad(F.col("_at").cast("string"), 20, "0"), order.groupBy(F.col("read_id").alias("_of")).agg(F.min("at").alias("_at"))


def sam_lines(records: DataFrame, refs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(kind, key, line): header lines, then records by read, see _place; x0, x1 and xa are tags where records have them."""
    place, places = _place(order, "qname")
    if places is not None:
        records = records.join(places, F.col("qname") == F.col("_of"), "left")
    tags = F.when(F.col("as_i").isNotNull(), F.concat(F.lit("AS:i:"), "as_i", F.lit("\tNM:i:"), "nm_i", F.lit("\t"))).otherwise("")
    more = F.lit("")
    if "xa" in records.columns:
        more = F.when(F.col("xa").isNotNull(), F.concat(F.lit("\tX0:i:"), "x0", F.lit("\tX1:i:"), "x1", F.lit("\tXA:Z:"), "xa")).otherwise("")
    columns = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    body = records.select(F.lit(3).alias("kind"), F.concat_ws("\t", place, F.lpad("flag", 5, "0")).alias("key"), F.concat(F.concat_ws("\t", *columns), F.lit("\t"), tags, F.lit(f"PG:Z:{PROGRAM}"), more).alias("line"))
    spark = refs.sparkSession
    head = spark.createDataFrame([(0, "", f"@HD\tVN:1.6\tSO:{'queryname' if order is None else 'unsorted'}"), (1, "", f"@PG\tID:{PROGRAM}\tPN:{PROGRAM}")], body.schema)
    names = refs.select(F.lit(2).alias("kind"), F.lpad(F.col("seq_idx").cast("string"), 20, "0").alias("key"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.length("seq").cast("string")).alias("line"))
    return head.union(names).union(body)


def with_xa(records: DataFrame, hits: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """The primary and unmapped rows of sam_records with x0, x1 and xa, which list the hits whose rows are left out."""
    listed = xa_records(hits, reads, refs).select(F.col("qname").alias("_qname"), "x0", "x1", "xa")
    primary = records.where(F.col("flag").bitwiseAND(F.lit(FLAG_SECONDARY)) == 0)
    return primary.join(listed, F.col("qname") == F.col("_qname"), "left").drop("_qname")


def xa_records(hits: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per mapped read: its primary hit, x0 (other best hits), x1 (the rest) and xa, which lists both."""
    rows = _with_reads(hits, reads, refs)
    sign = F.when(F.col("strand") == "RC", "-").otherwise("+")
    entry = F.concat("name", F.lit(","), sign, (F.col("begin") + 1).cast("string"), F.lit(",*,"), F.col("distance").cast("string"), F.lit(";"))
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", entry.alias("e"))))), lambda x: x["e"])
    out = rows.groupBy("read_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("name", "begin", "strand", "distance", "mapq"))).alias("p"), F.max("n_best").alias("n_best"), F.count(F.lit(1)).alias("n"), F.array_join(others, "").alias("xa"),
    )
    return out.select(F.col("read_id").alias("qname"), F.col("p.name").alias("rname"), (F.col("p.begin") + 1).alias("pos"), F.col("p.strand").alias("strand"), F.col("p.distance").alias("nm_i"), F.col("p.mapq").alias("mapq"), (F.col("n_best") - 1).alias("x0"), (F.col("n") - F.col("n_best")).alias("x1"), "xa")


def rhs_lines(records: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(kind, key, line) of rhs_records, by read, see _place."""
    place, places = _place(order, "read_id")
    if places is not None:
        records = records.join(places, F.col("read_id") == F.col("_of"), "left")
    return records.select(F.lit(0).alias("kind"), place.alias("key"), "line")


def rhs_records(hits: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """(read_id, line): 'id<TAB>(name,d);(name,d)' by distance and sequence, each pair once; 'id<TAB>*' for unmapped reads."""
    pairs = hits.groupBy("read_id", "seq_idx", "distance").agg(F.lit(1)).join(refs.select("seq_idx", "name"), "seq_idx")
    listed = pairs.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("distance", "seq_idx", "name"))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: F.concat(F.lit("("), x["name"], F.lit(","), x["distance"].cast("string"), F.lit(")"))), ";")
    return reads.select("read_id").join(listed, "read_id", "left").select("read_id", F.concat("read_id", F.lit("\t"), F.coalesce(text, F.lit("*"))).alias("line"))


def mapping_stats(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: n_reads, n_mapped, n_hits, hits_per_read, mapped_percent."""
    per = hits.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    out = reads.select("read_id").join(per, "read_id", "left").agg(F.count(F.lit(1)).alias("n_reads"), F.count("n").alias("n_mapped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"))
    return out.withColumn("hits_per_read", F.col("n_hits") / F.col("n_reads")).withColumn("mapped_percent", F.col("n_mapped") * 100 / F.col("n_reads"))


def hits_median(hits: DataFrame) -> DataFrame:
    """One row: n_mapped and the median number of hits of a mapped read, exact."""
    per = hits.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_mapped"), F.median("n").alias("median_hits"))
