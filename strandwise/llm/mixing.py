"""Operator 6: mixing sources to target weights by hash thresholds. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bits of the hash, bits of it that each histogram resolves, and the parts in which equal rows are numbered.
HASH_BITS, LEVEL_BITS, NUMBER_PARTS = 60, 10, 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(text: Column) -> Column:
    """60 bits of the MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def mixing_key(doc_id: Column, source: Column, text: Column) -> Column:
    """The hash of the id in decimal (null: the word null), the source after an s (null: nothing) and the text (null: empty)."""
    return _hash(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def with_hash(rows: DataFrame, key: str, hash_: str) -> DataFrame:
    """rows with the column hash_ in place of key: the key, or for rows that repeat one, but for the first of them, the hash of key and number.

    So equal rows are dealt over the hashes like others. Keys are counted before the shuffle, and only rows
    that repeat one are numbered: by part of the staged rows, then within it, so that a key with very many rows is no single group.
    """
    repeated = stage(rows.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_of"), "repeated-keys")
    if repeated.isEmpty():
        return rows.withColumnRenamed(key, hash_)
    one = rows.join(repeated, F.col(key) == F.col("_of"), "left_anti").withColumnRenamed(key, hash_)
    some = rows.join(repeated, F.col(key) == F.col("_of"), "left_semi").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(NUMBER_PARTS)))
    some = stage(some, "repeated-rows")
    counts = some.groupBy(F.col(key).alias("_of"), F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_of").orderBy("_at")) - F.col("_n")
    counts = stage(counts.select("_of", "_at", before.alias("_before")), "repeated-counts")
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.lit(0))) - 1
    numbered = some.withColumn("_number", within).join(counts, (F.col(key) == F.col("_of")) & (F.col("_part") == F.col("_at")))
    number = F.col("_number") + F.col("_before")
    hashed = F.when(number == 0, F.col(key)).otherwise(_hash(F.concat_ws(":", F.col(key).cast("string"), number.cast("string"))))
    return one.unionByName(numbered.withColumn(hash_, hashed).select(one.columns))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Per source: source_size, weight, target. Sources go by code point, null last, and take the weights in turn.

    Targets are level * weight, stopped at max_repeats * source_size; the level makes them sum to
    the total. With sources in the order of the level at which they stop, the level is the largest
    rest / rest of weights among sources that don't stop below it. One row per source reaches the
    unpartitioned windows.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("weight", w.cast("long"))
    full = F.col("source_size") * max_repeats
    before = Window.orderBy((full / F.col("weight")).asc(), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0)),
            "rest_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("below", F.col("rest") * F.col("weight") <= full * F.col("rest_weight"))
    level = F.max(F.when(F.col("below"), F.col("rest").cast("double") / F.col("rest_weight").cast("double"))).over(everything)
    target = F.when(F.col("below"), level * F.col("weight")).otherwise(full.cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def source_thresholds(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per source: source_size, target, copies (whole), bound and take_bound: rows whose hash is below bound get one copy more.

    sizes needs source, size and hash. What is left of a target after whole copies is a budget for
    one more copy of some rows. Its bound is found level by level: sizes are summed by source and
    hash bucket, the bucket where the running sum passes the budget is the boundary, and only the
    rows in it are summed again by the next bits. Rows of the last boundary (one hash) are taken if
    that comes nearer to the budget.
    """
    targets = source_targets(sizes, weights, max_repeats)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("copies", copies)
    state = state.withColumn("left", F.floor(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")).withColumn("at", F.lit(0).cast("long"))
    state = stage(state, "targets")
    rows = sizes.where("size > 0").select("source", "size", "hash")
    bounds = state.select("source", "left", "at")
    for done in range(0, HASH_BITS, LEVEL_BITS):
        known = bounds.select(F.col("source").alias("s"), "left", "at")
        above = F.shiftright("hash", HASH_BITS - done) == F.col("at")
        inside = rows.join(known, F.col("source").eqNullSafe(F.col("s")) & above)
        bucket = F.shiftright("hash", HASH_BITS - done - LEVEL_BITS)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        boundary = sums.withColumn("running", running).where("running > left and running - n <= left")
        bounds = boundary.select("source", (F.col("left") - F.col("running") + F.col("n")).alias("left"), F.col("bucket").alias("at"), "n")
    bounds = bounds.select(F.col("source").alias("s"), F.col("at").alias("bound"), (F.col("left") * 2 > F.col("n")).alias("take_bound"))
    out = state.join(bounds, F.col("source").eqNullSafe(F.col("s")), "left")
    return stage(out.select("source", "source_size", "target", "copies", F.coalesce("bound", F.lit(-1)).alias("bound"), F.coalesce("take_bound", F.lit(False)).alias("take_bound")), "thresholds")


def copies_of(hash_: Column) -> Column:
    """Copies of a row that is joined to its source's thresholds."""
    return F.col("copies") + ((hash_ < F.col("bound")) | ((hash_ == F.col("bound")) & F.col("take_bound"))).cast("long")


def document_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, key of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mixing_key(F.col(id_col).cast("long"), F.col(source_col), F.col(text_col)).alias("key"))


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, **columns: str) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (size times its copies).

    A null text has size 0; a null source is a source, the last one; ids and texts of any length are hashed whole, and equal rows
    by their number besides, so that null or repeated ids don't move a source from its target; a source of size 0 has target 0; an empty table gives an empty result; other columns of docs, whatever their names, are not read.
    Sizes are counted once and staged; after that only sums by source and bucket are shuffled, and
    the table of thresholds (a row per source) is joined without a hint, so Spark broadcasts it
    only while it is small.
    """
    sizes = stage(with_hash(stage(document_sizes(docs, **columns), "keys"), "key", "hash"), "sizes")
    bounds = source_thresholds(sizes, weights, max_repeats).withColumnRenamed("source", "s")
    mixed = sizes.join(bounds, F.col("source").eqNullSafe(F.col("s")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies_of(F.col("hash"))).alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them. Empty texts are not taken.

    Rows are hashed as in mix_sources: of rows that are equal in id and text as many are taken, and which of them, if other
    columns differ, is open. All columns of docs, whatever their names, are in the result; an empty table gives an empty one.
    """
    sizes = stage(with_hash(stage(document_sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col), "keys"), "key", "hash"), "sizes")
    bounds = source_thresholds(sizes, weights, max_repeats).select(F.col("source").alias("_mix_source"), "copies", "bound", "take_bound")
    names = docs.columns
    renamed = docs.select([F.col(f"`{c}`").alias(f"_in_{n}") for n, c in enumerate(names)])
    source, ident, text = (F.col(f"_in_{names.index(c)}") for c in (source_col, id_col, text_col))
    hashed = with_hash(renamed.where(word_count(text) > 0).withColumn("_key", mixing_key(ident.cast("long"), source, text)), "_key", "_hash")
    joined = hashed.join(bounds, source.eqNullSafe(F.col("_mix_source")))
    repeated = joined.withColumn("_n", copies_of(F.col("_hash"))).where("_n > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, _n)")))
    return repeated.select([F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)])


def oracle_sql(weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> str:
    """The same mix in DuckDB, by one sort of each source."""
    weight = " ".join(f"WHEN {n} THEN {w}" for n, w in enumerate(weights))
    return f"""
WITH d0 AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce('s' || source, '') || ':' || coalesce(text, '')), 1, {HASH_BITS // 4}))::BIGINT AS key
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM d0),
d AS (SELECT doc_id, source, size, CASE WHEN number = 0 THEN key ELSE ('0x' || substr(md5(key || ':' || number), 1, {HASH_BITS // 4}))::BIGINT END AS h FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (CASE (rank - 1) % {len(weights)} {weight} END)::BIGINT AS weight FROM s),
r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum({max_repeats} * source_size) OVER before, 0)::BIGINT AS rest,
         sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS rest_weight
  FROM w WINDOW before AS (ORDER BY {max_repeats} * source_size / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, rest * weight <= {max_repeats} * source_size * rest_weight AS below FROM r),
t AS (
  SELECT source, source_size, CASE WHEN below THEN max(CASE WHEN below THEN rest::DOUBLE / rest_weight::DOUBLE END) OVER () * weight
         ELSE ({max_repeats} * source_size)::DOUBLE END AS target FROM b),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
l AS (SELECT *, floor(target - copies * source_size)::BIGINT AS budget FROM c),
x AS (
  SELECT d.doc_id, d.size, l.source_size, l.target, l.copies, l.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS through, sum(d.size) OVER (PARTITION BY d.source, h)::BIGINT AS same
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, size * (copies + CASE
    WHEN through <= budget OR (through - same <= budget AND 2 * (budget - through + same) > same) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM x"""
