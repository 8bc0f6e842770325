"""Corpus pipeline over ``documents``: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spineworks.llm import chunks, cotraining, mixing, packing, simhash
from spineworks.llm.common import stage, tokenizer_path


def _others(docs: DataFrame, *named: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in named)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = cotraining.score(docs, cotraining.train(docs, labels), keep=_others(docs, "text"))
    return scored.where("accepted").select(*[F.col("text") if c == "text" else F.col("carried").getField(c).alias(c)
                                             for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class (4-word shingles, 4 bits)."""
    return simhash.one_of_each(docs, width=4, distance=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those of which no word is left go."""
    kept = chunks.dedup_substrings(docs, keep=_others(docs, "text"))
    kept = kept.where("words = 0 or removed_words < words")
    length = F.when(F.size("starts") > 0, F.char_length("text")).otherwise(F.col("carried.n_chars"))
    made = {"text": F.col("text"), "n_chars": length}
    return kept.select(*[made.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a small cache, since the workers also hold what the stages before left them."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, cache_pieces=300_000)


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", near_dedup),
          ("substring dedup", substring_dedup), ("mixing sources", mix_sources), ("packing", pack)]
ORACLE_SQL = None  # SQL cannot express the classifier, the fingerprints, the chunks or the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all stages applied to ``documents``; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
