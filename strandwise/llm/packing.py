"""Operator 10: packing by first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes, in_arrow, row_key, shuffle_partitions, slices
from .encoding import KEPT_PIECES, encoder

BATCH_BYTES = 1 << 21
#: Pieces that are packed together. A group is what one tree holds in memory.
GROUP = 1 << 14

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack_documents(docs: DataFrame, tokenizer: str, *, seq_len: int = 2048, end_id: int = 1, with_ids: bool = False, kept_pieces: int = KEPT_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids].

    A document's tokens and end id are cut at multiples of seq_len; full pieces are sequences of
    their own. The remaining piece of each document goes to a group at random (by a hash of the
    row, so reruns agree), and each group is packed by first-fit decreasing. Sequence ids hold the
    partition in their high bits and are unique, not dense. A null text is empty (its end id alone);
    null ids stay null; repeated rows are all packed; an empty table gives an empty result; texts of
    any length are encoded whole, with a table of at most kept_pieces in a worker; other columns of docs, whatever their names, are not read. Only
    piece lengths and checksums are shuffled (and the ids, with_ids), never texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", row_key("doc_id", "text"))
    last = ", ids binary" if with_ids else ""
    bound_batches(docs.sparkSession)
    pieces = rows.transform(in_arrow, partial(_cut, tokenizer=tokenizer, seq_len=seq_len, end_id=end_id, with_ids=with_ids, kept=kept_pieces), f"{_PIECE}, key long{last}")
    parts = shuffle_partitions(docs.sparkSession)
    # full pieces of one long document are dealt out by their start
    dealt = pieces.repartition(parts, F.xxhash64("key", "start")).sortWithinPartitions(F.xxhash64("key", F.lit(7)), "doc_id", "start")
    return dealt.transform(in_arrow, partial(_pack, seq_len=seq_len, with_ids=with_ids), f"{_PIECE}, sequence_id long, offset long{last}")


def _cut(batches, tokenizer: str, seq_len: int, end_id: int, with_ids: bool, kept: int):
    end, step = np.array([end_id], "<u4").tobytes(), 4 * seq_len
    use = encoder(tokenizer, kept)
    for part in slices(batches, 1, BATCH_BYTES):
        out = []
        doc_ids, keys = part.column(0).to_pylist(), part.column(2).to_pylist()
        for i, key, ids in zip(doc_ids, keys, use.ids(part.column(1))):
            ids += end
            for at in range(0, len(ids), step):
                piece = ids[at : at + step]
                out.append((i, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, key, piece))
        columns = list(zip(*out))
        kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "key"] + ["ids"] * with_ids)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of each item; the largest items first, each into the first bin that has room.

    The tree's leaves are bins, and an inner node holds the most room below it: the winner of the
    tournament of its two children. Going left wherever the left child has room finds the first bin.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        left = room[node] - need
        room[node] = left
        while node > 1:
            other = room[node ^ 1]
            node //= 2
            best = left if left > other else other
            if room[node] == best:
                break
            room[node] = left = best
    return bins, offsets


def _pack(batches, seq_len: int, with_ids: bool):
    from pyspark import TaskContext

    used = TaskContext.get().partitionId() << 40
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def pieces():
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield from zip(*columns, batch.column("ids").to_pylist() if with_ids else [None] * batch.num_rows)

    for group in by_bytes(pieces(), lambda _: 1, GROUP):
        bins, offsets = first_fit_decreasing([p[2] for p in group], seq_len)
        columns = [*zip(*(p[:5] for p in group)), [used + b for b in bins], offsets]
        if with_ids:
            columns.append([p[5] for p in group])
        used += max(bins) + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
