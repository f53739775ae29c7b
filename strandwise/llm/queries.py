"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .media import audio_features, media_digest
from . import compression_quality, infilling, line_dedup, mixing, ngram_join, quality, spelling, suffix_dedup, warc
from .ngram_join import linked_documents
from .packing import pack_documents
from .suffix_dedup import remove_repeats, repeat_digest
from .token_counts import count_tokens
from .token_store import digest_store, store_folder, write_store

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op2_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(audio_features(read_table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(remove_repeats(read_table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(warc.write_archive(read_table(spark, sf_dir, "pages"), warc.archive_folder(spark), min_revisit_bytes=0))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeats=3).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged_documents(read_table(spark, sf_dir, "documents"), host_col="source").drop("rk", "removed")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(read_table(spark, sf_dir, "documents"), shingle=3, similarity=(9, 10)).select("doc_id", "n_shingles", "component_id")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_store(write_store(read_table(spark, sf_dir, "documents"), BYTE_BPE, store_folder(spark), end_id=2))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE, seq_len=2048, end_id=1)


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return compression_quality.quality_scores(docs, compression_quality.fitted(docs, read_table(spark, sf_dir, "labels")), threshold=0.3)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(read_table(spark, sf_dir, "documents"), misspell_every=97, least_length=5, least_count=3, factor=2)


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.infilling_digest(infilling.fill_in_middle(read_table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_media_features": op2_media_features,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_token_store": op9_token_store,
    "op10_packing": op10_packing,
    "op11_compression_quality": op11_compression_quality,
    "op12_spelling": op12_spelling,
    "op13_infilling": op13_infilling,
}

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.oracle_sql(),
    "op4_warc": warc.oracle_sql(),
    "op5_line_dedup": line_dedup.oracle_sql(),
    "op6_mixing": mixing.oracle_sql(),
    "op7_quality_rules": quality.oracle_sql(),
    "op8_ngram_jaccard_join": ngram_join.oracle_sql(),
    "op13_infilling": infilling.oracle_sql(),
}
