"""Shared helpers: the shared folder, staged tables, row keys and byte-balanced batches."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables are staged if the cluster names no folder (single-machine tests).
FALLBACK_DIR = "/tmp/checkpoints/strandwise"
#: The most row keys that are broadcast (16 MB) to read only those rows' texts; with more, all texts are joined.
MOST_KEYS = 1 << 21
#: Rows of a file of a staged table whose size is known, and the fewest files.
FILE_ROWS, LEAST_FILES = 1 << 16, 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master gets a folder of its own; any other is refused, as executors
    would write to disks that the others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^,]*(,\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs(FALLBACK_DIR, exist_ok=True)
        found = f"file://{FALLBACK_DIR}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/strandwise-{tag}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have these bounds at most, so that long texts don't add up in a worker.

    They must hold when a result runs, which is after the operator has returned it. Smaller bounds stay.
    """
    sc = spark.sparkContext
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)):
        now = sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def stage(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive executors.

    rows, where it is known, bounds the files: one for about FILE_ROWS rows, so that a small table
    is not dealt over as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    bound_batches(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables whose consumers are all written."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str | Column, text_col: str | Column) -> Column:
    """A 64-bit key of (id, text). Rows equal in both are interchangeable, so they may share it. The hash passes over nulls, so
    whether a column is null is hashed besides: a null id with some text is not an id whose bytes are that text's."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (id_col, text_col)]
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def slices(batches, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, without a copy, whose strings in the column sum to about limit bytes; a longer one stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def by_bytes(items: Iterable[tuple], size, limit: int) -> Iterator[list]:
    """Lists of consecutive items whose sizes sum to about limit; an item above it stands alone."""
    held, total = [], 0
    for item in items:
        n = size(item)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(item)
        total += n
    if held:
        yield held


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function of batches; as the task ends its worker gives memory back, as it may idle for long."""
    return df.mapInArrow(partial(_tidy, function=function), schema)


def _tidy(batches, function):
    try:
        yield from function(batches)
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)


def _pick(batches, keys, inside: bool, then):
    def picked():
        for batch in batches:
            rk = batch.column("rk").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys.value, rk), max(0, len(keys.value) - 1))
            hit = keys.value[at] == rk if len(keys.value) else np.zeros(len(rk), bool)
            yield batch.filter(pa.array(hit == inside))

    yield from then(picked()) if then else picked()


def rows_with(rows: DataFrame, wanted: DataFrame, then=None, schema: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key rk is among wanted.rk, all others); with more than MOST_KEYS keys (rows, None), so callers join in any case.

    then, with its schema, is a function of batches that the first go through in the same worker.
    """
    keys = wanted.select("rk").distinct()
    n = keys.count()
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if n > MOST_KEYS:
        return rows.transform(in_arrow, then, schema) if then else rows, None
    found = keys.toArrow().column(0).to_numpy() if n else np.zeros(0, np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(found))
    some = rows.transform(in_arrow, partial(_pick, keys=shared, inside=True, then=then), schema or own)
    return some, rows.transform(in_arrow, partial(_pick, keys=shared, inside=False, then=None), own)
