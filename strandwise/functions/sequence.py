"""Column functions on nucleotide strings, distances and SAM fields."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most errors that identity bounds allow.
MAX_DISTANCE = 13
_ACGT = np.zeros(256, bool)
_ACGT[np.frombuffer(b"ACGTacgt", np.uint8)] = True
MAPQ_UNIQUE, FLAG_REVERSE, FLAG_SECONDARY, FLAG_UNMAPPED = 60, 16, 256, 4


def ascii_upper(text: Column) -> Column:
    """Only a-z change: the upper case of some other letters is two letters."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def keep_acgt(text: Column) -> Column:
    return F.regexp_replace(ascii_upper(text), "[^ACGT]", "")


def _only_acgt(batches):
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        sizes = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # values are side by side from the first offset on; nulls have none
        letters = np.frombuffer(b"".join(x for x in text.cast(pa.binary()).to_pylist() if x), np.uint8)
        keep = _ACGT[letters]
        before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        ends = np.cumsum(sizes)
        offsets = np.concatenate([[0], before[ends]]).astype(np.int32)
        valid = pc.is_valid(text)
        packed = np.packbits(valid.to_numpy(zero_copy_only=False), bitorder="little") if text.null_count else None
        seq = pa.StringArray.from_buffers(len(text), pa.py_buffer(offsets), pa.py_buffer(letters[keep] & 0xDF), pa.py_buffer(packed) if packed is not None else None, text.null_count)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], seq], names=batch.schema.names)


def with_acgt(rows: DataFrame, text: str) -> DataFrame:
    """rows with keep_acgt of a column, which then is the last: a mask over the bytes of a batch, many times as fast on long texts."""
    bound_batches(rows.sparkSession)
    others = [c for c in rows.columns if c != text]
    ordered = rows.select(*others, text)
    return ordered.mapInArrow(_only_acgt, ordered.schema)


def bound_batches(spark) -> None:
    """Arrow batches of a few MB from now on, as a row can be a piece of 64 KB or a document. Smaller bounds stay."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)):
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def mask_ambiguous(text: Column) -> Column:
    """Reads: upper case, all but A, C, G and T as N."""
    return F.regexp_replace(ascii_upper(text), "[^ACGT]", "N")


def contains_ambiguous(text: Column) -> Column:
    return text.rlike("[^ACGT]")


def revcomp(seq: Column) -> Column:
    """Reverse complement; other letters stay as they are, reversed."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def pack_kmer(kmer: Column) -> Column:
    """Up to 31 letters as a number of base 4: A 0, C 1, G 2, T 3; null with any other letter."""
    return F.when(~contains_ambiguous(kmer), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


def unpack_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def letter_code(letter: Column) -> Column:
    """A 0, C 1, G 2, T 3; -1 for any other."""
    return (F.instr(F.lit("ACGT"), letter) - 1).cast("long")


def code_letter(code: Column) -> Column:
    """The letter of a code; null for -1."""
    return F.when(code.between(0, 3), F.substring(F.lit("ACGT"), code.cast("int") + 1, F.lit(1)))


def push_right(code: Column, letter: Column, k: int) -> Column:
    """A packed k-mer that has moved one letter to the right."""
    return F.shiftleft(code.bitwiseAND(F.lit(4 ** (k - 1) - 1)), 2).bitwiseOR(letter_code(letter))


def push_left(code: Column, letter: Column, k: int) -> Column:
    """A packed k-mer that has moved one letter to the left."""
    return F.shiftright(code, 2).bitwiseOR(F.shiftleft(letter_code(letter), 2 * (k - 1)))


def revcomp_kmer(code: Column, k: int) -> Column:
    """The packed reverse complement of a packed k-mer."""
    return pack_kmer(revcomp(unpack_kmer(code, k)))


def header_name(header: Column) -> Column:
    return F.substring_index(header, " ", 1)


def replacement_seed(length: int, start: int = 42) -> str:
    """A fixed string of nucleotides from a multiplicative generator."""
    out, x = [], start
    for _ in range(length):
        x = x * 48271 % 2147483647
        out.append("ACGT"[x * 4 // 2147483647])
    return "".join(out)


def fill_ambiguous(df: DataFrame, column: str, seed_length: int = 100) -> DataFrame:
    """References: upper case, each stretch of other letters filled with the seed from its start, again and again.

    With seed_length 0 every such letter is drawn anew, from a generator that its sequence starts.
    """
    return df.mapInArrow(partial(_fill, column=column, seed=replacement_seed(seed_length) if seed_length else ""), df.schema)


_UPPER = {c: c - 32 for c in range(ord("a"), ord("z") + 1)}


def _fill(batches, column: str, seed: str):
    def one(text):
        if text is None:
            return None
        text = text.translate(_UPPER)
        if seed:
            return re.sub("[^ACGT]+", lambda m: (seed * (len(m[0]) // len(seed) + 1))[: len(m[0])], text)
        letters = iter(replacement_seed(sum(c not in "ACGT" for c in text)))
        return re.sub("[^ACGT]", lambda _: next(letters), text)

    for batch in batches:
        i = batch.schema.get_field_index(column)
        yield batch.set_column(i, column, pa.array(map(one, batch.column(i).to_pylist()), pa.string()))


def distance_for_identity(length: Column, identity: Column) -> Column:
    """The most errors at an identity of so many per cent."""
    return F.least(F.lit(MAX_DISTANCE), F.floor(length * (100 - identity) / 100)).cast("long")


def mapq(is_best: Column, n_best: Column) -> Column:
    many = F.round(F.lit(-10) * F.log10(1 - 1 / n_best))
    return F.when(~is_best, 0).when(n_best == 1, MAPQ_UNIQUE).otherwise(many).cast("long")


def sam_flag(strand: Column, primary: Column) -> Column:
    return (F.when(strand == "RC", FLAG_REVERSE).otherwise(0) + F.when(primary, 0).otherwise(FLAG_SECONDARY)).cast("long")


def human_size(n: float) -> str:
    """Bytes in the largest unit that leaves at least one of it, with two digits."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024


def human_time(seconds: float) -> str:
    """Hours, minutes and seconds, without leading units that are zero."""
    whole = int(seconds)
    hours, minutes = whole // 3600, whole // 60 % 60
    parts = [f"{hours}h"] * (hours > 0) + [f"{minutes}m"] * (hours + minutes > 0)
    return " ".join([*parts, f"{seconds - whole + whole % 60:.2f}s"])
