"""Suffix arrays, Burrows-Wheeler transforms and what follows from them, per text, as windows over one partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BY = "text_id"
#: Moduli below 2 ** 31, so that products fit in 63 bits, and bases of the prefix hashes.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 747796405)


def characters(texts: DataFrame) -> DataFrame:
    """(text_id, pos, c) of text and a final $, from texts(text_id, text)."""
    letters = F.split(F.concat("text", F.lit("$")), "")
    return texts.select(_BY, F.posexplode(F.filter(letters, lambda x: x != "")).alias("pos", "c")).select(_BY, F.col("pos").cast("long").alias("pos"), "c")


def suffix_array(texts: DataFrame) -> DataFrame:
    """(text_id, i, sa, c, n): position of the i-th suffix, its first character, the text's length with $.

    Prefix doubling: ranks by the first 1, 2, 4, ... characters, each from the last by a window, all
    within the partitioning by text. Rounds follow the longest text.
    """
    rows = characters(texts).repartition(_BY)
    longest = texts.agg(F.max(F.length("text"))).first()[0] or 0
    by_pos = Window.partitionBy(_BY).orderBy("pos")
    rows = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(_BY).orderBy("c")))
    step = 1
    while step <= longest:
        rows = rows.withColumn("next", F.coalesce(F.lead("rank", step).over(by_pos), F.lit(0)))
        rows = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(_BY).orderBy("rank", "next"))).drop("next")
        step *= 2
    return rows.select(_BY, (F.col("rank").cast("long") - 1).alias("i"), F.col("pos").alias("sa"), "c", F.count(F.lit(1)).over(Window.partitionBy(_BY)).alias("n"))


def bwt(sa: DataFrame) -> DataFrame:
    """(text_id, i, sa, c, n, b): b precedes the i-th suffix, circularly."""
    before = F.lag("c").over(Window.partitionBy(_BY).orderBy("sa"))
    last = F.first("c").over(Window.partitionBy(_BY).orderBy(F.desc("sa")))
    return sa.withColumn("b", F.coalesce(before, last))


def runs(transformed: DataFrame) -> DataFrame:
    """(text_id, run, b, begin, length, first_sa, last_sa): maximal stretches of one character, with their end samples."""
    change = F.when(F.lag("b").over(Window.partitionBy(_BY).orderBy("i")) == F.col("b"), 0).otherwise(1)
    numbered = transformed.withColumn("change", change).withColumn("run", F.sum("change").over(Window.partitionBy(_BY).orderBy("i")) - 1)
    return numbered.groupBy(_BY, "run").agg(F.first("b").alias("b"), F.min("i").alias("begin"), F.count(F.lit(1)).alias("length"), F.min_by("sa", "i").alias("first_sa"), F.max_by("sa", "i").alias("last_sa"))


def lf_mapping(transformed: DataFrame) -> DataFrame:
    """(text_id, i, b, lf): the row of the suffix that is longer by b."""
    return transformed.select(_BY, "i", "b", (F.row_number().over(Window.partitionBy(_BY).orderBy("b", "i")) - 1).cast("long").alias("lf"))


def phi(sa: DataFrame) -> DataFrame:
    """(text_id, sa, phi, phi_inverse): positions of the suffixes before and after in order, circularly."""
    up = Window.partitionBy(_BY).orderBy("i")
    down = Window.partitionBy(_BY).orderBy(F.desc("i"))
    return sa.select(_BY, "sa", F.coalesce(F.lag("sa").over(up), F.first("sa").over(down)).alias("phi"), F.coalesce(F.lead("sa").over(up), F.first("sa").over(up)).alias("phi_inverse"))


def plcp(texts: DataFrame, sa: DataFrame) -> DataFrame:
    """(text_id, pos, plcp): the common extension of the suffix at pos and the one before it in order. A text is sent once, beside its pairs."""
    pairs = sa.select(_BY, F.col("sa").alias("pos"), F.lag("sa").over(Window.partitionBy(_BY).orderBy("i")).alias("other"))
    return pairs.groupBy(_BY).cogroup(texts.select(_BY, "text").groupBy(_BY)).applyInArrow(_extensions, "text_id long, pos long, plcp long")


def _extensions(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    text = texts.column("text")[0].as_py() if texts.num_rows else None
    other = pairs.column("other").fill_null(-1).to_numpy()
    pos = pairs.column("pos").to_numpy()
    found = np.where(other >= 0, common_extensions((text or "").encode("ascii", "replace"), pos, np.maximum(other, 0)), 0)
    return pa.table([pairs.column("text_id"), pairs.column("pos"), pa.array(found, pa.int64())], names=["text_id", "pos", "plcp"])


def common_extensions(text: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters follow alike from each a and b on. All pairs are halved together: prefix hashes modulo two primes tell whether
    so many letters agree, in as many steps as the text's length has bits."""
    n = len(text)
    letters = np.frombuffer(text, np.uint8).astype(np.int64)
    sums, powers = [], []
    for prime, base in zip(PRIMES, BASES):
        power = np.ones(n + 1, np.int64)
        done, step = 1, base
        while done <= n:  # step is base to the done
            power[done : 2 * done] = power[:done][: n + 1 - done] * step % prime
            done, step = 2 * done, step * step % prime
        sums.append(np.concatenate([[0], np.cumsum(letters * power[:n] % prime)]))
        powers.append(power)
    one, two = np.minimum(a, b), np.maximum(a, b)
    least, most = np.zeros(len(one), np.int64), np.maximum(n - two, 0)
    one, two = np.minimum(one, n), np.minimum(two, n)
    while (least < most).any():
        size = (least + most + 1) // 2
        alike = np.ones(len(one), bool)
        for prime, total, power in zip(PRIMES, sums, powers):
            left = (total[one + size] - total[one]) % prime * power[two - one] % prime
            alike &= left == (total[two + size] - total[two]) % prime
        least, most = np.where(alike, size, least), np.where(alike, most, size - 1)
    return least


def backward_search(transformed: DataFrame, patterns: DataFrame, length: int) -> DataFrame:
    """(text_id, pattern, begin, end): rows of the suffixes that start with each pattern of so many characters.

    Each step narrows a range to the rows that the mapping of its next character, from the right,
    leads to: begin is the least of them and end the greatest, plus one.
    """
    lf = lf_mapping(transformed).select(_BY, "i", "b", "lf").withColumnRenamed(_BY, "t")
    sizes = transformed.groupBy(_BY).agg(F.max("n").alias("end"))
    state = patterns.join(sizes, _BY).select(_BY, "pattern", F.lit(0).cast("long").alias("begin"), "end")
    for k in range(length, 0, -1):
        c = F.substring("pattern", k, 1)
        step = state.join(lf, (F.col(_BY) == F.col("t")) & (F.col("b") == c) & (F.col("i") >= F.col("begin")) & (F.col("i") < F.col("end")))
        state = step.groupBy(_BY, "pattern").agg(F.min("lf").alias("begin"), (F.max("lf") + 1).alias("end"))
    return state


def locate(ranges: DataFrame, sa: DataFrame) -> DataFrame:
    """(text_id, pattern, pos): text positions of the rows of each range."""
    rows = sa.select(F.col(_BY).alias("t"), "i", "sa")
    found = ranges.join(rows, (F.col(_BY) == F.col("t")) & (F.col("i") >= F.col("begin")) & (F.col("i") < F.col("end")))
    return found.select(_BY, "pattern", F.col("sa").alias("pos"))


def run_outputs(transformed: DataFrame) -> DataFrame:
    """(text_id, run, output, output_run): where the mapping leads the first row of each run, and the run that lies in.

    An as-of search of outputs among run starts, by a window over both.
    """
    starts = runs(transformed).select(_BY, "run", F.col("begin").alias("i"))
    leads = starts.join(lf_mapping(transformed), [_BY, "i"]).select(_BY, "run", F.col("lf").alias("output"))
    none = F.lit(None).cast("long")
    both = starts.select(_BY, F.col("i").alias("at"), F.col("run").alias("start"), none.alias("run"), F.lit(0).alias("kind")).union(leads.select(_BY, F.col("output").alias("at"), none.alias("start"), F.col("run"), F.lit(1).alias("kind")))
    last = F.last("start", True).over(Window.partitionBy(_BY).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("output_run", last).where("kind = 1").select(_BY, "run", F.col("at").alias("output"), "output_run")


def sample_before(transformed: DataFrame) -> DataFrame:
    """(text_id, pos, sample): the first sample of a run at or before each text position, circularly the greatest of all."""
    samples = runs(transformed).select(_BY, F.col("first_sa").alias("pos"), F.col("first_sa").alias("s"))
    joined = transformed.select(_BY, F.col("sa").alias("pos")).join(samples, [_BY, "pos"], "left")
    before = F.last("s", True).over(Window.partitionBy(_BY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    greatest = F.max("s").over(Window.partitionBy(_BY))
    return joined.select(_BY, "pos", F.coalesce(before, greatest).alias("sample"))


def is_permutation(sa: DataFrame) -> DataFrame:
    """(text_id, good): whether positions are 0 to n - 1, each once."""
    n = F.count(F.lit(1))
    return sa.groupBy(_BY).agg(((F.min("sa") == 0) & (F.max("sa") == n - 1) & (F.count_distinct("sa") == n)).alias("good"))


def reverse_bwt(texts: DataFrame) -> DataFrame:
    """(text_id, i, b): the transform of each text read from its end, which extensions to the right need."""
    return bwt(suffix_array(texts.select(_BY, F.reverse("text").alias("text")))).select(_BY, "i", "b")


def character_ranges(sa: DataFrame) -> DataFrame:
    """(text_id, c, begin, end): rows of the suffixes that start with each character; together they are the complete range."""
    n = sa.groupBy(_BY, "c").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.partitionBy(_BY).orderBy("c"))
    return n.select(_BY, "c", (end - F.col("n")).alias("begin"), end.alias("end"))


def rank_select(transformed: DataFrame) -> DataFrame:
    """(text_id, i, b, rank, following): how often b stands before row i, and the row where it stands next, if any."""
    same = Window.partitionBy(_BY, "b").orderBy("i")
    return transformed.select(_BY, "i", "b", (F.row_number().over(same) - 1).cast("long").alias("rank"), F.lead("i").over(same).alias("following"))


def _rows_of(ranges: DataFrame, transformed: DataFrame) -> DataFrame:
    """Ranges with b and lf of each of their rows."""
    lf = lf_mapping(transformed).withColumnRenamed(_BY, "t")
    return ranges.join(lf, (F.col(_BY) == F.col("t")) & (F.col("i") >= F.col("begin")) & (F.col("i") < F.col("end"))).drop("t", "i")


def extend_alphabet(ranges: DataFrame, transformed: DataFrame) -> DataFrame:
    """(text_id, pattern, begin, end): each pattern longer by one letter on the left, for every letter that stands there."""
    rows = _rows_of(ranges, transformed).where("b <> '$'")
    return rows.groupBy(_BY, F.concat("b", "pattern").alias("pattern")).agg(F.min("lf").alias("begin"), (F.max("lf") + 1).alias("end"))


def bidirectional_search(transformed: DataFrame, patterns: DataFrame, length: int) -> DataFrame:
    """(text_id, pattern, begin, end, rev_begin, rev_end): rows of a pattern, and of its reverse among suffixes of the reversed text.

    The second range is as wide as the first. A letter on the left moves it by the rows of the first
    whose letter is smaller, so both stay together without a second transform.
    """
    sizes = transformed.groupBy(_BY).agg(F.max("n").alias("end"))
    zero = F.lit(0).cast("long")
    state = patterns.join(sizes, _BY).select(_BY, "pattern", zero.alias("begin"), "end", zero.alias("rev_begin"))
    for k in range(length, 0, -1):
        c = F.substring("pattern", k, 1)
        own = F.when(F.col("b") == c, F.col("lf"))
        step = _rows_of(state, transformed).groupBy(_BY, "pattern", "rev_begin")
        step = step.agg(F.min(own).alias("begin"), (F.max(own) + 1).alias("end"), F.count(F.when(F.col("b") < c, 1)).alias("less"))
        state = step.where(F.col("begin").isNotNull()).select(_BY, "pattern", "begin", "end", (F.col("rev_begin") + F.col("less")).alias("rev_begin"))
    return state.withColumn("rev_end", F.col("rev_begin") + F.col("end") - F.col("begin"))


def toeholds(ranges: DataFrame, sa: DataFrame) -> DataFrame:
    """(text_id, pattern, toehold, occurrences): the text position of a range's last row, from which others follow by phi."""
    last = sa.select(F.col(_BY).alias("t"), "i", F.col("sa").alias("toehold"))
    found = ranges.join(last, (F.col(_BY) == F.col("t")) & (F.col("i") == F.col("end") - 1))
    return found.select(_BY, "pattern", "toehold", (F.col("end") - F.col("begin")).alias("occurrences"))
