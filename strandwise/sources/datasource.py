"""FASTA and FASTQ as a data source: byte ranges of files, each of which finds its first record by itself.

Rows are (at, header, seq, qual); at grows with file (in order of name) and place, so records keep the
order of the input without a shuffle. Files whose names end in .gz can't be cut and are one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "strandwise_sequences"
#: Bits of at for the place in a file; bytes of a range, of a read, and of records in a batch.
PLACE_BITS, RANGE_BYTES, READ_BYTES, BATCH_BYTES = 44, 64 << 20, 1 << 20, 4 << 20
FASTA_ENDINGS, FASTQ_ENDINGS = ("fasta", "fa", "fna", "FASTA", "FA"), ("fq", "fastq")
SCHEMA = "at long, header string, seq string, qual string"


def ending(path: str) -> str:
    return path.removesuffix(".gz").rsplit(".", 1)[-1]


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _files(uri: str, kind: str = "") -> list[tuple[str, int, int]]:
    """(path, size, time of change in ns) of the file, or of the folder's files by name: those with a known ending, or with a kind all but hidden ones."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.Directory:
        found = [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.base_name[0] not in "._"]
        found = [x for x in found if kind or ending(x.base_name) in FASTA_ENDINGS + FASTQ_ENDINGS]
    else:
        found = [info]
    return sorted((x.path, x.size, x.mtime_ns or 0) for x in found)


@dataclass
class Range(InputPartition):
    """Records that start at start to end - 1 of a file; end is None where the file can't be cut."""

    path: str
    number: int
    start: int
    end: int | None
    fastq: bool


def _lines(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) from the first line on that begins at start or later."""
    if start:
        f.seek(start - 1)
    at, held = max(start - 1, 0), b""
    skip = start > 0
    while block := f.read(READ_BYTES):
        lines = (held + block).split(b"\n")
        held = lines.pop()
        for line in lines:
            if not skip:
                yield at, line.rstrip(b"\r")
            at, skip = at + len(line) + 1, False
    if held and not skip:
        yield at, held.rstrip(b"\r")


def _fasta(lines, end: int | None):
    """(place, header, letters, "") of each record that starts before end; > or @ starts one, and its letters may be on many lines."""
    at, header, parts = None, b"", []
    for place, line in lines:
        if line[:1] in (b">", b"@"):
            if at is not None:
                yield at, header, b"".join(parts), b""
            at, header, parts = place, line[1:], []
            if end is not None and place >= end:
                return
        elif at is not None:
            parts.append(b"".join(line.split()))
        elif end is not None and place >= end:
            return
    if at is not None:
        yield at, header, b"".join(parts), b""


def _fastq(lines, start: int, end: int | None):
    """(place, header, letters, quality) of each record of four lines that starts before end.

    A range that doesn't begin its file takes the first line with @ whose second next line has +: a line of quality may
    begin with @, but then a sequence stands two lines below it.
    """
    held: list[tuple[int, bytes]] = []
    found = start == 0
    for place, line in lines:
        held.append((place, line))
        if not found:
            if len(held) < 3:
                continue
            if not (held[0][1].startswith(b"@") and held[2][1].startswith(b"+")):
                held.pop(0)
                continue
            found = True
        if held[0][1] == b"" and len(held) == 1:
            held.clear()  # empty lines between records
            continue
        if len(held) == 4:
            if end is not None and held[0][0] >= end:
                return
            (at, header), (_, seq), (_, plus), (_, qual) = held
            if not header.startswith(b"@") or not plus.startswith(b"+"):
                raise ValueError(f"not a FASTQ record: {header.decode(errors='replace')}")
            yield at, header[1:], seq.strip(), qual.strip()
            held.clear()
    if found and held and (end is None or held[0][0] < end):
        raise ValueError(f"not a FASTQ record: {held[0][1].decode(errors='replace')}")


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    system, path = _filesystem(part.path)
    opened = system.open_input_stream(path, compression="gzip", buffer_size=READ_BYTES) if part.end is None and path.endswith(".gz") else system.open_input_file(path)
    with opened as f:
        lines = _lines(f, part.start)
        rows = _fastq(lines, part.start, part.end) if part.fastq else _fasta(lines, part.end)
        held, size = [], 0
        for at, header, seq, qual in rows:
            held.append(((part.number << PLACE_BITS) + at, header.decode(errors="replace"), seq.decode(errors="replace"), qual.decode(errors="replace")))
            size += len(header) + len(seq) + len(qual) + 32
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows) -> pa.RecordBatch:
    a, *texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *(pa.array(t, pa.string()) for t in texts)], names=["at", "header", "seq", "qual"])


def _ranges(files: list[tuple[int, str, int]], size: int, scheme: str, kind: str) -> list[Range]:
    out = []
    for number, path, n in files:
        fastq = kind == "fastq" if kind else ending(path) in FASTQ_ENDINGS
        if path.endswith(".gz"):
            out.append(Range(scheme + path, number, 0, None, fastq))
        else:
            out += [Range(scheme + path, number, at, min(n, at + size), fastq) for at in range(0, n, size)]
    return out


def _scheme(uri: str) -> str:
    """What stands before the paths that a file system lists."""
    from pyarrow import fs

    system, _ = _filesystem(uri)
    return "" if isinstance(system, fs.LocalFileSystem) else uri.split("://")[0] + "://"


class SequenceFiles(DataSource):
    """Option path: a file or a folder; option rangebytes: bytes of a range; option kind: fasta or fastq for files of any name."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.kind = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options.get("kind", "")
        if self.kind not in ("", "fasta", "fastq"):
            raise ValueError("kind must be fasta or fastq")

    def partitions(self) -> list[Range]:
        return _ranges([(number, path, n) for number, (path, n, _) in enumerate(_files(self.path, self.kind))], self.size, _scheme(self.path), self.kind)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    """Files are taken in order of their time of change and name, whole once they are listed; a file that appears with an earlier
    time than one already read is not read. Files are best moved in when they are complete. at is only ordered within a file."""

    def __init__(self, options):
        self.path, self.size, self.kind = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options.get("kind", "")
        if self.kind not in ("", "fasta", "fastq"):
            raise ValueError("kind must be fasta or fastq")

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = max(((t, p) for p, _, t in _files(self.path, self.kind)), default=(-1, ""))
        return {"time": found[0], "path": found[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        files = [(0, p, n) for p, n, t in _files(self.path, self.kind) if after < (t, p) <= upto]
        return _ranges(files, self.size, _scheme(self.path), self.kind)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceFiles)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, kind: str = ""):
    """(at, header, seq, qual) of the records of a file or folder."""
    register(spark)
    return spark.read.format(NAME).options(path=path, rangebytes=str(range_bytes), kind=kind).load()


def read_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, kind: str = ""):
    """The same of files as they appear in a folder."""
    register(spark)
    return spark.readStream.format(NAME).options(path=path, rangebytes=str(range_bytes), kind=kind).load()
