"""The suffix array of one text that no task could hold: prefix doubling by sums over distinct keys, in written rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.intervals import running_sum
from strandwise.sources.storage import written

#: Letters that the first key holds: a number of base 5 in 63 bits, the end of the text being its least digit.
FIRST = 27
#: Positions times ranks must stay within 63 bits.
MOST_LETTERS = 3_000_000_000

_DIGIT = np.zeros(256, np.uint64)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = np.arange(1, 5, dtype=np.uint64)


def leading(letters: np.ndarray, k: int) -> np.ndarray:
    """The k letters from each place on as a number of base 5, the first letter most significant; nothing follows the last one."""
    power, size = np.concatenate([_DIGIT[letters], np.zeros(k, np.uint64)]), 1
    out, have, rest = None, 0, k
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, size
            else:  # what is there stands before
                n = len(power) - have
                out, have = out[:n] * np.uint64(5**size) + power[have : have + n], have + size
        rest >>= 1
        if rest:
            n = len(power) - size
            power, size = power[:n] * np.uint64(5**size) + power[size : size + n], 2 * size
    return out[: len(letters)]


def _first_keys(batches):
    for batch in batches:
        for first, lead, own, body in zip(*(batch.column(c).to_pylist() for c in ("first", "lead", "own", "body"))):
            keys = leading(np.frombuffer(body, np.uint8)[lead:], FIRST)[:own].astype(np.int64)
            for at in range(0, own, 1 << 16):
                some = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(some))), pa.array(some)], names=["pos", "key"])


def _joined(rows: DataFrame, keys: DataFrame, key: str, tag: str) -> DataFrame:
    """rows beside their key's row; keys are written, so that Spark can split the rows of a hot key."""
    keys = written(keys.withColumnRenamed(key, "_key"), tag)
    return rows.join(keys, F.col(key) == F.col("_key")).drop("_key")


def suffix_array(pieces: DataFrame, letters: int) -> DataFrame:
    """(i, sa): the position of the i-th suffix of a text of ACGT and an end that is smaller than any letter.

    pieces are those of one text of so many letters, with FIRST letters or more behind each (see intervals.text_of_all).
    Suffixes are ranked by FIRST letters, then by twice as many in each round: what a round sorts are distinct keys
    with their counts, in ranges, so equal suffixes are no group of rows anywhere, and only suffixes that still share
    a rank take part. Every round is written; rounds follow the logarithm of the longest repeat.
    """
    if letters > MOST_LETTERS:
        raise ValueError(f"a text of more than {MOST_LETTERS} letters")
    spark = pieces.sparkSession
    last = spark.range(1).select(F.lit(letters).cast("long").alias("pos"), F.lit(0).cast("long").alias("key"))
    rows = written(pieces.select("first", "lead", "own", "body").mapInArrow(_first_keys, "pos long, key long").unionByName(last), "keys")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    summed = running_sum(counts, "key", "rows", "rank")
    ranks = written(_joined(rows, summed, "key", "ranks").select("pos", "rank", (F.col("rows") == 1).alias("alone")), "ranks")
    size = FIRST
    while True:
        shared = ranks.where("not alone").select("pos", "rank")
        if shared.isEmpty():
            return ranks.select(F.col("rank").alias("i"), F.col("pos").alias("sa"))
        following = ranks.select((F.col("pos") - size).alias("_of"), F.col("rank").alias("_next"))
        # two suffixes that share so many letters both go on behind them
        pairs = shared.join(following, F.col("pos") == F.col("_of")).select("pos", "rank", (F.col("rank") * (letters + 2) + F.col("_next")).alias("key"))
        pairs = written(pairs, "pairs")
        counts = written(pairs.groupBy("key", "rank").agg(F.count(F.lit(1)).alias("rows")), "counts")
        summed = written(running_sum(counts, "key", "rows", "smaller"), "sums")
        least = summed.groupBy("rank").agg(F.min("smaller").alias("_least"))
        summed = _joined(summed, least, "rank", "least").select("key", "rows", (F.col("rank") + F.col("smaller") - F.col("_least")).alias("rank"))
        again = _joined(pairs.select("pos", "key"), summed, "key", "ranks").select("pos", "rank", (F.col("rows") == 1).alias("alone"))
        ranks = written(ranks.where("alone").unionByName(again), "ranks")
        size *= 2
