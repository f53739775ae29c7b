"""Mapping of reads that arrive in files: each micro-batch is one run against the same references."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandwise.plans.mapping import MapConfig, map_reads


def map_stream(reads: DataFrame, refs: DataFrame, output: str, checkpoint: str, config: MapConfig | None = None, **trigger):
    """Starts a query that appends hits of a streaming reads(read_id, seq) to Parquet in output, in a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so hits are written once.
    """
    trigger = trigger or {"availableNow": True}

    def one(batch: DataFrame, number: int) -> None:
        map_reads(batch, refs, config).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()
