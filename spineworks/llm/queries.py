"""Registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bounded_topk, chunks, collision_search, cotraining, licenses, mixing, packing, prefix_trie, scoring,
               simhash, suffix_levels, token_files, variants)
from .common import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 4-word shingles, links at 4 or fewer differing bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, distance=4)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the passages that documents before it have."""
    return chunks.dedup_substrings(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by source: weights 5, 2, 1, 150% of all words, at most twice each."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every 20th embedding, among all."""
    return collision_search.nearest(_table(spark, sf_dir, "embeddings"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th embedding, among all."""
    return bounded_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as rANS token files of the byte-level vocabulary, read back."""
    return token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents; the target are documents labelled good."""
    docs = _table(spark, sf_dir, "documents")
    return scoring.score(docs, scoring.labelled(_table(spark, sf_dir, "labels")),
                         tokenizer_path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by two co-trained views."""
    docs = _table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, _table(spark, sf_dir, "labels")))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of at most 2048 tokens of the word vocabulary."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt over the heads of their groups' first ones."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes that also start earlier."""
    return suffix_levels.digests(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, under their frequent neighbours."""
    return variants.group(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_substring_dedup, op3_mix_sources, op4_nearest, op5_exact_top_k, op6_license_scan,
    op7_token_files, op8_lm_score, op9_quality, op10_pack, op11_prefix_trie, op12_suffix_dedup,
    op13_spelling_variants)}
ORACLE: dict[str, str] = {"op3_mix_sources": mixing.ORACLE, "op5_exact_top_k": bounded_topk.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE,
                          "op12_suffix_dedup": suffix_levels.ORACLE, "op13_spelling_variants": variants.ORACLE}
