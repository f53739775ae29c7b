"""Operator 1: token counts of whole texts, by batch encoding in Arrow functions."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_arrow, slices
from .encoding import encoder

#: Bytes of text handled at a time in one task.
BATCH_BYTES = 1 << 22


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A map without a shuffle: a task reads its rows in batches balanced by bytes, long texts are
    cut at safe boundaries, and only lengths leave the Arrow function. A null text counts as
    empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated results; an
    empty table gives an empty result. Other columns of docs, whatever their names, are not read.
    A text of any length is encoded whole, in slices cut at white space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    return rows.transform(in_arrow, partial(_count, tokenizer=tokenizer, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _count(batches, tokenizer: str, limit: int):
    use = encoder(tokenizer)
    for part in slices(batches, 1, BATCH_BYTES):
        n = pa.array(use.lengths(part.column(1)), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64()), n, pc.greater(n, limit)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )
