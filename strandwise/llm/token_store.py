"""Operator 9: token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each of which holds up to FRAME_IDS ids (unsigned 32 bits,
little-endian) and decompresses alone, then a skippable frame with the documents' index, then
the skippable frame that the seekable format of zstandard defines: for each frame its compressed
size, decompressed size and the low 32 bits of its content's XXH64, and at the end the number of
frames, a descriptor and a magic number. Readers without an interest in single documents can
decompress the file as it is.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes, in_arrow, new_path, shuffle_partitions, slices, stage
from .encoding import encoder
from .storage import TemporaryFile, filesystem, remove_temporary, split_ranges

FRAME_IDS, LEVEL, BATCH_BYTES = 1 << 16, 3, 1 << 22
#: What a row weighs besides its text when ranges are cut.
ROW_BYTES = 32
#: Fixed values of the zstandard format: skippable frames, seek table; ours: the index.
SEEK_MAGIC, SEEKABLE_END, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: Bit 7 of the descriptor: entries have checksums.
DESCRIPTOR = 0x80


def write_store(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every row and writes the shards; returns the manifest (shard, path, n_docs, n_tokens, n_bytes).

    Rows go in ascending id order, null ids first, equal ids by their tokens. A null text is
    empty and holds the end id alone; repeated rows are all written; an empty table gives an
    empty manifest and no file; a text of any length is encoded whole; other columns of docs, whatever
    their names, are not read. Ids are cut into ranges by exact sums of bytes, ids that many rows have
    by a hash of those rows besides (they go by that hash, then by tokens); a task writes one range,
    and a file appears under its name only when it is whole, so a lost executor costs its tasks and
    nothing else. Ranges are storage.RANGE_BYTES of text, larger ones where more than storage.MOST_RANGES would
    come of it. The manifest is a table in the shared folder: it is the commit.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = split_ranges(rows, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
    rows = rows.withColumn("hash", F.xxhash64("text"))
    bound_batches(docs.sparkSession)
    encoded = rows.transform(in_arrow, partial(_encode, tokenizer=tokenizer, end_id=end_id, ranges=spark.sparkContext.broadcast(ranges)), "shard int, doc_id long, wide boolean, ids binary")
    ordered = encoded.repartitionById(len(ranges), "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    written = stage(ordered.transform(in_arrow, partial(_write, folder=folder), "shard long, path string, n_docs long, n_tokens long, n_bytes long"), "manifest")
    remove_temporary(folder)
    return written


def read_store(manifest: DataFrame) -> DataFrame:
    """Reads the listed files whole: doc_id, start (ids of all documents before), n_tokens, ids (binary), in file order per shard."""
    return _scan(manifest, True)


def digest_store(manifest: DataFrame) -> DataFrame:
    """As read_store, with ids_crc32 in place of the ids."""
    return _scan(manifest, False)


def _scan(manifest: DataFrame, ids: bool) -> DataFrame:
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("first", F.coalesce(before, F.lit(0).cast("long"))).select("path", "first")  # a row for each file
    last = "ids binary" if ids else "ids_crc32 long"
    return shards.repartition(4 * shuffle_partitions(manifest.sparkSession), "path").transform(in_arrow, partial(_read, ids=ids), f"doc_id long, start long, n_tokens long, {last}")


def read_documents(path: str, doc_ids: set[int]) -> dict[int, list[bytes]]:
    """The ids of the requested documents of one file; only frames that hold them are decompressed."""
    with _Shard(path) as shard:
        found: dict[int, list[bytes]] = {}
        for i, start, n in shard.index():
            if i in doc_ids:
                found.setdefault(i, []).append(shard.ids(start, n))
        return found


def _encode(batches, tokenizer: str, end_id: int | None, ranges):
    """Ids travel in 16 bits each where the vocabulary and the end id allow it: wide is false."""
    use = encoder(tokenizer)
    kind = np.dtype(np.uint16 if use.type == np.uint16 and (end_id or 0) < 1 << 16 else "<u4")
    for part in slices(batches, 1, BATCH_BYTES):
        flat, counts = use.encode(part.column(1))
        ends = np.cumsum(counts)
        if end_id is not None:
            flat, ends = np.insert(flat.astype(kind), ends, end_id), ends + np.arange(1, len(ends) + 1)
        offsets = np.concatenate([[0], ends]) * kind.itemsize
        ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.astype(kind))])
        shard = ranges.value.of(part.column(0), part.column(2)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(shard), part.column(0), pa.array(np.full(len(ends), kind.itemsize == 4)), ids], names=["shard", "doc_id", "wide", "ids"])


class _Writer:
    def __init__(self, folder: str, shard: int):
        import zstandard

        self.shard, self.file = shard, TemporaryFile(folder, f"tokens-{shard:08d}.zst")
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.held, self.size, self.n_tokens = [], 0, 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.index.append((doc_id, len(ids) // 4))
        self.n_tokens += len(ids) // 4
        for at in range(0, len(ids), 4 * FRAME_IDS):
            piece = ids[at : at + 4 * FRAME_IDS]
            if self.size + len(piece) > 4 * FRAME_IDS:
                self.flush()
            self.held.append(piece)
            self.size += len(piece)

    def flush(self) -> None:
        import xxhash

        if self.held:
            data = b"".join(self.held)
            packed = self.compress(data)
            self.file.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> tuple:
        self.flush()
        nulls = np.array([i is None for i, _ in self.index], np.uint8)
        index = self.compress(nulls.tobytes() + np.array([i or 0 for i, _ in self.index], "<i8").tobytes() + np.array([n for _, n in self.index], "<u4").tobytes())
        self.file.write(struct.pack("<III", INDEX_MAGIC, len(index) + 4, len(self.index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, SEEKABLE_END)
        self.file.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        return self.shard, self.file.commit(), len(self.index), self.n_tokens, self.file.written


def _write(batches, folder: str):
    names, writer = ["shard", "path", "n_docs", "n_tokens", "n_bytes"], None

    def row(values):
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if n == "path" else pa.int64()) for n, v in zip(names, values)], names=names)

    for batch in batches:
        for shard, doc_id, wide, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if not wide:
                ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            if writer is None or writer.shard != shard:
                if writer:
                    yield row(writer.close())
                writer = _Writer(folder, shard)
            writer.add(doc_id, ids)
    if writer:
        yield row(writer.close())


class _Shard:
    """Random access to one file through its seek table; the frame that was read last is kept."""

    def __init__(self, path: str):
        import zstandard

        fs, name = filesystem(path)
        self.file = fs.open_input_file(name)
        self.inflate = zstandard.ZstdDecompressor().decompress
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_END or flags != DESCRIPTOR:
            raise ValueError(f"{path}: no seek table with checksums")
        self.table = np.frombuffer(self.file.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        self.kept = (-1, b"")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def index(self):
        """(doc_id, start, n_tokens) of each document in file order."""
        at = int(self.packed[-1])
        magic, size, n = struct.unpack("<III", self.file.read_at(12, at))
        data = self.inflate(self.file.read_at(size - 4, at + 12), max_output_size=13 * n)
        nulls, ids, counts = np.frombuffer(data, np.uint8, n), np.frombuffer(data, "<i8", n, n), np.frombuffer(data, "<u4", n, 9 * n).astype(np.int64)
        starts = np.cumsum(counts) - counts
        for null, i, s, c in zip(nulls.tolist(), ids.tolist(), starts.tolist(), counts.tolist()):
            yield None if null else i, s, c

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.kept[0] != k:
            size, plain, check = self.table[k].tolist()
            data = self.inflate(self.file.read_at(size, int(self.packed[k])), max_output_size=plain)
            if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} fails its checksum")
            self.kept = k, data
        return self.kept[1]

    def ids(self, start: int, n: int) -> bytes:
        lo, hi, out = 4 * start, 4 * (start + n), []
        k = int(np.searchsorted(self.plain, lo, "right")) - 1
        while lo < hi:
            base = int(self.plain[k])
            piece = self.frame(k)[lo - base : hi - base]
            out.append(piece)
            lo, k = lo + len(piece), k + 1
        return b"".join(out)


def _read(batches, ids: bool):
    for batch in batches:
        for path, first in zip(*(c.to_pylist() for c in batch.columns)):
            with _Shard(path) as shard:
                rows = ((i, first + s, n, shard.ids(s, n)) for i, s, n in shard.index())
                for group in by_bytes(rows, lambda r: len(r[3]) + 32, BATCH_BYTES):
                    a, b, c, d = zip(*group)
                    last = pa.array(d, pa.binary()) if ids else pa.array([zlib.crc32(x) for x in d], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids" if ids else "ids_crc32"])


def store_folder(spark) -> str:
    return new_path(spark, "tokens")
