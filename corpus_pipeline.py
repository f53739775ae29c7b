"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder and rereads it as the next stage's docs, so a lost executor costs no more than
the running stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import line_dedup, mixing, ngram_join, packing, quality
from strandwise.llm.common import read_table, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars is that of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose lines that are frequent on their source."""
    return _documents(quality.cleaned_documents(docs, host_col="source", keep=CARRIED))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that is nothing but repeated lines stays, with what it keeps."""
    return _documents(line_dedup.drop_repeated_lines(docs, min_chars=40, min_docs=5, keep=CARRIED))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at a similarity of 0.8, the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, shingle=5, similarity=(8, 10)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, weights=(1, 2, 3), max_repeats=3).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. Workers go on to other stages, so their tables stay small."""
    return packing.pack_documents(docs, TOKENIZER, seq_len=2048, end_id=1, kept_pieces=50_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


#: Packing and components have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None
