"""Operator 4: a deterministic sharded WARC writer, and the reader.

Records are sorted by page id within ranges of ids, ranges are cut by exact counts, and files roll
by compressed size, so the same pages give the same files byte by byte. Every record is a gzip
member of its own. Headers are made anew: record ids and dates come from the content and a
parameter, digests from the payload. Files are written under temporary names and renamed; a
manifest (a table in the shared folder) lists what belongs to the archive and is the commit.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_arrow, new_path, shuffle_partitions, stage, unstage
from .storage import TemporaryFile, filesystem, remove_temporary, split_ranges

LEVEL, READ_BYTES, BATCH_BYTES = 6, 1 << 20, 1 << 22
#: A file rolls once it holds such a part of the bytes that a range has before compression, and at 1 GB at most.
ROLL_PART, MOST_ROLL = 16, 1 << 30
#: What a row weighs besides its texts when ranges are cut.
ROW_BYTES = 200
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member. Equal arguments give equal bytes: the member holds no time or name."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    text = f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, html: bytes, digest: str, target: int | None, date: str, revisit: bool) -> bytes:
    """A response with its payload, or a revisit whose payload can be regenerated from the response that it names."""
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"
    fields = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(html)))]
    if not revisit:
        return record("response", [*fields, ("Content-Type", "application/http; msgtype=response")], HTTP_OK + html)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(target, digest)), ("X-Refers-To-Page-Id", str(target)), ("Content-Type", "application/http; msgtype=response")]
    return record("revisit", fields, HTTP_OK)


def write_archive(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, roll_bytes: int | None = None, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes every row as a record; returns the manifest (shard, part, path, n_records, n_bytes, sha256).

    Of rows with equal payloads of at least min_revisit_bytes, the one with the largest id is the
    response and the others revisit it; among rows that repeat that id too, one is the response.
    Null ids rank below all and come first; if only null ids hold a payload, all are responses.
    A null payload is empty; a null url is about:blank. An empty table gives an empty manifest. A
    payload of any length is one record; other columns of pages, whatever their names, are not read.
    Ranges of ids are cut by exact sums of bytes (see split_ranges), ids that many rows have by the payload's digest
    besides. Within a range a file rolls once its compressed size reaches roll_bytes; without it, a sixteenth of a
    range, so that a range of pages, which compress to a quarter or so, becomes several files and files grow with the input.

    Only digests and ids are shuffled to find responses: largest ids per digest, taken before the
    shuffle, then a join whose stream side Spark can split. Payloads are shuffled once, to their range.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    ranges = split_ranges(rows, "page_id", F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + ROW_BYTES)
    roll_bytes = roll_bytes or min(MOST_ROLL, ranges.share // ROLL_PART)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    sha = F.unhex(F.sha2(payload, 256))
    # a row of its own carries each target to the shard of its page, where it sorts before the page
    large = rows.where(F.octet_length(payload) >= min_revisit_bytes).select("page_id", sha.alias("sha"))
    best = large.groupBy("sha").agg(F.max("page_id").alias("target")).where("target is not null").withColumnRenamed("sha", "of")
    best = stage(best, "warc-targets")  # so that Spark can split the pages of a hot payload
    targets = large.join(best, F.col("sha") == F.col("of")).select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "target").distinct()
    payloads = rows.select("page_id", sha.alias("sha"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("target"))
    both = payloads.union(targets).withColumn("hash", F.xxhash64("sha"))  # a page and its target share it
    ranged = both.transform(in_arrow, partial(_range, ranges=spark.sparkContext.broadcast(ranges)), "shard int, page_id long, sha binary, kind int, url string, html string, target long")
    ordered = ranged.repartitionById(len(ranges), "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "sha", "kind", "url")
    written = ordered.transform(in_arrow, partial(_write, folder=folder, roll_bytes=roll_bytes, date=date), "shard long, part long, path string, n_records long, n_bytes long, sha256 string")
    written = stage(written, "warc-manifest")
    remove_temporary(folder)
    unstage(best)
    return written


def _range(batches, ranges):
    for batch in batches:
        shard = pa.array(ranges.value.of(batch.column("page_id"), batch.column("hash")).astype("int32"))
        yield pa.RecordBatch.from_arrays([shard, *batch.columns[:-1]], names=["shard", *batch.schema.names[:-1]])


class _File:
    def __init__(self, folder: str, shard: int, part: int, date: str):
        self.shard, self.part = shard, part
        self.name = f"pages-{shard:08d}-{part:05d}.warc.gz"
        self.file, self.sha, self.n = TemporaryFile(folder, self.name), hashlib.sha256(), 0
        info = f"software: strandwise\r\nformat: {VERSION}\r\n".encode()
        self.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, self.name)}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)

    def close(self) -> tuple:
        return self.shard, self.part, self.file.commit(), self.n, self.file.written, self.sha.hexdigest()


def _write(batches, folder: str, roll_bytes: int, date: str):
    names = ["shard", "part", "path", "n_records", "n_bytes", "sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    out, last, known = None, None, None

    def row(values):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        for shard, page_id, sha, kind, url, html, target in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                known = page_id, sha, target
                continue
            data = (html or "").encode()
            digest = base32_sha1(data)
            target = known[2] if known and known[:2] == (page_id, sha) else None
            # equal ids and payloads stand together: the first of them is the response
            revisit = target is not None and (page_id != target or last == (page_id, sha))
            last = page_id, sha
            if out is not None and (out.shard != shard or out.file.written >= roll_bytes):
                part = out.part + 1 if out.shard == shard else 0
                yield row(out.close())
                out = _File(folder, shard, part, date)
            elif out is None:
                out = _File(folder, shard, 0, date)
            out.write(page_record(page_id, url, data, digest, target, date, revisit))
            out.n += 1
    if out is not None:
        yield row(out.close())


def records(path: str):
    """(headers, block) of each record of a file, member by member."""
    fs, name = filesystem(path)
    with fs.open_input_stream(name, compression=None) as f:
        z, held, left = zlib.decompressobj(31), [], f.read(READ_BYTES)
        while left:
            held.append(z.decompress(left))
            if not z.eof:
                left = f.read(READ_BYTES)
                continue
            head, _, rest = b"".join(held).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != VERSION:
                raise ValueError(f"{path}: not a {VERSION} record")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[: int(fields["Content-Length"])]
            if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
                raise ValueError(f"{path}: a record's length is wrong")
            if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"{path}: a record fails its digest")
            yield fields, block
            left, held, z = z.unused_data or f.read(READ_BYTES), [], zlib.decompressobj(31)
        if held:
            raise ValueError(f"{path}: cut off")


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Reads the listed files: page_id, payload_bytes, payload_digest, record_type, refers_to [, url, html].

    Responses' payloads are hashed anew and held against their headers; a revisit's length and digest
    are its header's. With payloads, revisits get null html: it is that of the page they refer to.
    """
    more = ", url string, html string" if payloads else ""
    files = manifest.select("path").repartition(4 * shuffle_partitions(manifest.sparkSession), "path")
    return files.transform(in_arrow, partial(_read, payloads=payloads), _PAGE + more)


def _read(batches, payloads: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "html"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * 2 * payloads

    def rows(path):
        for fields, block in records(path):
            kind = fields["WARC-Type"]
            if kind == "warcinfo":
                continue
            page, digest, html = fields["X-Page-Id"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
            size = int(fields["X-Payload-Length"])
            if kind == "response":
                body = block[block.index(b"\r\n\r\n") + 4 :]
                if (len(body), base32_sha1(body)) != (size, digest):
                    raise ValueError(f"{path}: page {page} fails its payload digest")
                html = body.decode() if payloads else None
            refers = fields.get("X-Refers-To-Page-Id")
            row = int(page) if page else None, size, digest, kind, int(refers) if refers else None
            yield row + (fields["WARC-Target-URI"], html) if payloads else row

    for batch in batches:
        for path in batch.column(0).to_pylist():
            for group in by_bytes(rows(path), lambda r: 200 + (len(r[-1] or "") if payloads else 0), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*group), kinds)], names=names)


def archive_folder(spark) -> str:
    return new_path(spark, "warc")


def oracle_sql(min_revisit_bytes: int = 0) -> str:
    """DuckDB; for ids that are not null and not repeated. Base 32 takes five bits at a time of the SHA-1's hex."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex || '00', 1 + (5 * i) // 4, 3))::INTEGER >> (7 - (5 * i) % 4)) & 31), 1)"
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS target FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: {digit}), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = target OR payload_bytes < {min_revisit_bytes} THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = target OR payload_bytes < {min_revisit_bytes} THEN NULL ELSE target END AS refers_to
FROM m"""
