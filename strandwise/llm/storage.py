"""Files in the shared folder: written under a temporary name, then renamed; ranges of ids for shards."""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Bytes of a range, which one task sorts (spilling) and writes, and the most ranges: beyond their product ranges grow
#: with the input. A level of the id histogram has HISTOGRAM buckets in all, or four for each open interval.
RANGE_BYTES, MOST_RANGES, HISTOGRAM = 12 << 20, 1 << 13, 1 << 16


def remove_temporary(folder: str) -> None:
    """Deletes what attempts that failed have left; call it once all tasks have ended."""
    from pyarrow import fs as pafs

    fs, path = filesystem(folder)
    for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if info.base_name.startswith("_temporary-"):
            fs.delete_file(info.path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder given as a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class TemporaryFile:
    """A file that gets its name only once it is whole. Attempts of one task write equal bytes, so the last rename is as good as the first."""

    def __init__(self, folder: str, name: str):
        self.fs, path = filesystem(folder)
        self.uri = f"{folder}/{name}"
        self.fs.create_dir(path, recursive=True)
        self.final, self.temporary = f"{path}/{name}", f"{path}/_temporary-{name}-{uuid.uuid4().hex}"
        self.out, self.written = self.fs.open_output_stream(self.temporary, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def commit(self) -> str:
        from pyarrow import fs

        self.out.close()
        there = self.fs.get_file_info(self.final)
        if there.type != fs.FileType.NotFound and there.size == self.written:
            self.fs.delete_file(self.temporary)  # an earlier attempt's, equal to this one; a reader may hold it
            return self.uri
        if there.type != fs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)
        return self.uri


class Ranges:
    """Ranges of ids in ascending order, nulls first. An id that is more than one range's share is cut by a hash of its rows."""

    def __init__(self, points: list[int], heavy: dict[int, int], nulls: int):
        """points: the first id of each range but the first; heavy: shares of single ids that are ranges of their own; nulls: shares of null ids."""
        self.points, self.share = np.array(points, np.int64), 0
        starts = [None, *points]
        shares = np.array([nulls] + [heavy.get(s, 1) if s is not None else 1 for s in starts], np.uint64)
        self.shares, self.first = np.maximum(shares, np.uint64(1)), np.concatenate([[0], np.cumsum(np.maximum(shares, np.uint64(1)))]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.first[-1])

    def of(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        """The range of each row; hashes (longs) matter for heavy ids only."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.where(null, 0, np.searchsorted(self.points, values, "right") + 1)
        part = (hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)) * self.shares[at] >> np.uint64(32)
        return self.first[at] + part.astype(np.int64)


def _histogram(batches, lo, hi, width):
    """(n, b, weight): the sum of weights in bucket b of the n-th interval; intervals ascend and don't overlap. n = -1: null ids."""
    names = ["n", "b", "weight"]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, weight = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        # unsigned distances: an interval can be wider than a long
        x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.searchsorted(lo, x, "right") - 1
        inside = ~null & (n >= 0)
        inside &= x <= hi[np.maximum(n, 0)]
        b = ((x.view(np.uint64) - lo.view(np.uint64)[np.maximum(n, 0)]) // width[np.maximum(n, 0)]).astype(np.int64)
        n, b = np.where(null, -1, n), np.where(null, 0, b)
        keep = np.flatnonzero(inside | null)
        keys, number = np.unique(np.stack([n[keep], b[keep]]), axis=1, return_inverse=True)
        sums = np.bincount(number.ravel(), weight[keep], minlength=keys.shape[1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(sums)], names=names)


def split_ranges(df: DataFrame, key: str, weight: Column, share: int | None = None) -> Ranges:
    """Ranges of df's rows by key (a long) whose weights sum to about share each.

    Without a share it is RANGE_BYTES, or what gives MOST_RANGES ranges if that is more: so intervals that
    need another histogram are at most as many, a level collects at most HISTOGRAM rows or four for each of
    them, and even ids need two scans, the first for the sum. The same rows give the same ranges, whatever their order or partitioning: sums come from exact
    histograms of equal-width buckets, every bucket of more than a share is cut anew, and a single
    key of more than a share is cut by hash. The driver sees sums, never rows.
    """
    rows = df.select(F.col(key), weight.cast("long").alias("w"))
    low, high, total = rows.agg(F.min(key), F.max(key), F.sum("w")).first()
    share = share or max(RANGE_BYTES, -(-(total or 0) // MOST_RANGES))
    nulls, points, heavy = 0, [], {}
    open_ = [(low, high)] if low is not None else [(0, 0)]
    while open_:
        lo, hi = (np.array(c, np.int64) for c in zip(*open_))
        each = max(4, HISTOGRAM // len(open_))
        width = np.array([max(1, -(-(b - a + 1) // each)) for a, b in open_], np.uint64)
        sums = rows.transform(in_arrow, partial(_histogram, lo=lo, hi=hi, width=width), "n long, b long, weight long").groupBy("n", "b").agg(F.sum("weight")).collect()
        again, running, at_n = [], 0, None
        for n, b, w in sorted(map(tuple, sums)):
            if n < 0:
                nulls = -(-w // share)
                continue
            if n != at_n:
                at_n, running = n, 0
                points.append(open_[n][0])  # what was open begins a range
            a = open_[n][0] + b * int(width[n])
            z = min(open_[n][1], a + int(width[n]) - 1)
            if w > share:
                points.append(a)
                if z > a:
                    again.append((a, z))
                else:
                    heavy[a] = -(-w // share)
                if z < open_[n][1]:
                    points.append(z + 1)
                running = 0
                continue
            if running + w > share:
                points.append(a)
                running = 0
            running += w
        open_ = again
    out = Ranges(sorted(set(points)), heavy, nulls)
    out.share = share
    return out
