"""Operator 5: removal of repeated lines with two Bloom filters, once seen and twice seen.

Each task marks the keys of its documents in two bitmaps: a bit goes from unseen to once seen
to twice seen. Bitmaps of tasks merge bit by bit (twice = twice or twice, or once and once), so
a key that two documents hold has all its bits in the merged second bitmap, wherever they were
read. A second pass shuffles only keys whose bits are all there; exact counts of these decide.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, row_key, stage

#: Bits per counted key, the most hash functions, bits of a segment, and the most bits of one filter (64 MB).
KEY_BITS, PROBES, SEGMENT, MOST_BITS = 12, 4, 1 << 19, 1 << 29
STRIP = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The line in UTF-8 without ASCII white space at its ends and with A-Z lower-cased; None if that is too short to count."""
    key = line.strip(STRIP)
    return key.encode().lower() if len(key) >= min_chars else None


def key_hash(key: bytes) -> bytes:
    """128 bits that stand for the key in filters and shuffles."""
    return hashlib.blake2b(key, digest_size=16).digest()


def probes(hashes: np.ndarray, bits: int, functions: int) -> np.ndarray:
    """Bit positions [keys, functions] of 128-bit hashes given as uint64 pairs. bits is a power of two."""
    step = np.arange(functions, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (hashes[:, :1] + step * (hashes[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def filter_bits(keys: int) -> int:
    """A power of two of about KEY_BITS bits a key; beyond MOST_BITS the filter only gets less selective, see suspected."""
    bits = SEGMENT
    while bits < min(MOST_BITS, keys * KEY_BITS):
        bits *= 2
    return bits


def suspected(keys: int, bits: int, functions: int) -> float:
    """The expected part of once-seen keys whose bits are all twice seen, of so many different keys."""
    load = keys * functions / bits
    return (1 - math.exp(-load) * (1 + load)) ** functions


def hash_functions(keys: int, bits: int) -> int:
    """How many hash functions leave the fewest suspects: PROBES while the filter is wide, fewer as it fills, 1 at the end."""
    return min(range(PROBES, 0, -1), key=lambda n: suspected(keys, bits, n))


def _document_keys(text: str, min_chars: int) -> set[bytes]:
    return {k for line in text.split("\n") if (k := line_key(line, min_chars)) is not None}


def _texts(batches):
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                yield text


def _pack(segment: int, once: np.ndarray, twice: np.ndarray) -> tuple:
    """Bits are packed by eight, the first of them highest."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    return segment, z.compress(once.tobytes()), z.compress(twice.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=SEGMENT // 8), np.uint8).copy()


_SEGMENTS = "segment int, once binary, twice binary"


def _rows(rows):
    if rows:
        a, b, c = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["segment", "once", "twice"])


def _set(filter_: np.ndarray, at: np.ndarray) -> None:
    """Sets the bits at ascending places."""
    if len(at):
        byte, bit = at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        filter_[byte[first]] |= np.bitwise_or.reduceat(bit, first)


def _are_set(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8) & np.uint8(128)) > 0


def _mark(batches, min_chars: int, bits: int, functions: int):
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    held: list[bytes] = []

    def flush():
        if held:
            at, n = np.unique(probes(np.frombuffer(b"".join(held), "<u8").reshape(-1, 2), bits, functions).ravel(), return_counts=True)
            # two keys of one document may share a bit: that marks a bit too many, never one too few
            _set(twice, at[(n > 1) | _are_set(once, at)])
            _set(once, at)
            held.clear()

    for text in _texts(batches):
        held += map(key_hash, _document_keys(text, min_chars))
        if len(held) >= 1 << 16:
            flush()
    flush()
    for s in range(0, bits, SEGMENT):
        part = slice(s // 8, (s + SEGMENT) // 8)
        if once[part].any():
            yield from _rows([_pack(s // SEGMENT, once[part], twice[part])])


def _merge(batches):
    """Segments arrive sorted; one is merged at a time."""
    at, once, twice = None, None, None
    for batch in batches:
        for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = _unpack(a), _unpack(b)
            if segment != at:
                if at is not None:
                    yield from _rows([_pack(at, once, twice)])
                at, once, twice = segment, a, b
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None:
        yield from _rows([_pack(at, once, twice)])


def twice_seen(docs: DataFrame, text_col: str, min_chars: int) -> tuple[np.ndarray, int]:
    """(the packed bits of the merged second filter, its hash functions): at most MOST_BITS / 8 bytes reach the driver, however large docs is."""
    texts = docs.select(F.col(text_col).alias("text"))
    # no more keys than lines, and no more than fit into the characters
    lines, chars = texts.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1), F.sum(F.length("text"))).first()
    keys = min(lines or 0, (chars or 0) // max(1, min_chars))
    bits = filter_bits(keys)
    functions = hash_functions(keys, bits)
    marks = texts.transform(in_arrow, partial(_mark, min_chars=min_chars, bits=bits, functions=functions), _SEGMENTS)
    merged = marks.repartition(max(1, min(64, bits // SEGMENT)), "segment").sortWithinPartitions("segment").transform(in_arrow, _merge, _SEGMENTS)
    out = np.zeros(bits // 8, np.uint8)
    for segment, packed in merged.select("segment", "twice").toLocalIterator():
        lo = segment * SEGMENT // 8
        out[lo : lo + SEGMENT // 8] = _unpack(packed)
    return out, functions


def _suspects(batches, min_chars: int, shared):
    bits, functions = shared.value
    n = np.uint64(8 * len(bits) - 1)
    for batch in batches:
        rows, held = [], []
        for i, rk, text in zip(*(c.to_pylist() for c in batch.columns)):
            for key in _document_keys(text or "", min_chars):
                rows.append((i, rk, key))
                held.append(key_hash(key))
        if not rows:
            continue
        at = probes(np.frombuffer(b"".join(held), "<u8").reshape(-1, 2), int(n) + 1, functions)
        keep = np.flatnonzero(_are_set(bits, at).all(1)).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[k][0] for k in keep], pa.int64()), pa.array([rows[k][1] for k in keep], pa.int64()), pa.array([held[k] for k in keep], pa.binary())],
            names=["doc_id", "rk", "hash"],
        )


def _drop(batches, min_chars: int):
    for batch in batches:
        out = []
        for text, dropped in zip(batch.column("_text").to_pylist(), batch.column("_dropped").to_pylist()):
            lines = (text or "").split("\n")
            gone = set(dropped or ())
            kept = [x for x in lines if not gone or (k := line_key(x, min_chars)) is None or key_hash(k) not in gone]
            # a document that loses nothing keeps its text as it is, null included
            out.append((text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
        texts, n, m = zip(*out) if out else ((), (), ())
        others = [c for c in batch.schema.names if c not in ("_text", "_dropped")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())],
            names=[*others, "_text", "_lines", "_lost"],
        )


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, the columns in keep, text without its dropped lines, n_lines, n_dropped.

    A key of at least min_chars code points in at least min_docs rows loses its lines everywhere
    but in the rows with the largest id that hold it. Null and empty texts are one empty line and
    come back as they are. A null id ranks below all; if only null ids hold a key, all keep it.
    Repeated rows are separate documents with one id, so they keep or lose a line together. An empty
    table gives an empty result. A text of any length is split whole, a row at a time. Names in keep
    must not be those of the result's own columns; any other may be there, kept or not.

    Shuffled are 16-byte hashes of suspected keys, and texts once, to meet their verdicts; hot keys
    are summed before the shuffle, and their rows only meet a one-row verdict per key, in a join
    whose skewed partitions Spark splits.
    """
    own = ("doc_id", "text", "n_lines", "n_dropped")
    if clash := set(keep) & set(own):
        raise ValueError(f"keep names columns of the result: {', '.join(sorted(clash))}")
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`").alias(f"_keep_{n}") for n, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *kept).withColumn("_rk", row_key("_id", "_text"))
    shared = spark.sparkContext.broadcast(twice_seen(docs, text_col, min_chars))
    found = rows.select("_id", "_rk", "_text").transform(in_arrow, partial(_suspects, min_chars=min_chars, shared=shared), "doc_id long, rk long, hash binary")
    suspects = stage(found, "suspects")
    verdicts = suspects.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
    verdicts = stage(verdicts.select("hash", "keeper"), "verdicts")  # so that Spark can split the suspects of a hot key
    lost = suspects.join(verdicts, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # the lines of one document: no more than its text holds
    lost = lost.groupBy("doc_id", "rk").agg(F.collect_set("hash").alias("_dropped"))
    joined = rows.join(lost, (F.col("_rk") == F.col("rk")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left").drop("_rk", "rk", "doc_id")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ("_id", *(f"_keep_{n}" for n in range(len(keep))), "_text"))
    out = joined.transform(in_arrow, partial(_drop, min_chars=min_chars), f"{schema}, _lines long, _lost long")
    return out.select(F.col("_id").alias("doc_id"), *(F.col(f"_keep_{n}").alias(c) for n, c in enumerate(keep)), F.col("_text").alias("text"), F.col("_lines").alias("n_lines"), F.col("_lost").alias("n_dropped"))


def line_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle_sql(min_chars: int = 40, min_docs: int = 5) -> str:
    """DuckDB; for ids that are not null and not repeated."""
    strip = "regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT doc_id, n, line, translate({strip}, '{upper}', '{lower}') AS key FROM l),
v AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
x AS (SELECT k.doc_id, k.n, k.line, v.key IS NOT NULL AND k.doc_id <> v.keeper AS dropped FROM k LEFT JOIN v USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM x GROUP BY doc_id"""
