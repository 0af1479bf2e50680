"""Corpus preparation: language ID, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwell.llm import decontaminate, language_id, mixing, near_dedup, sharding
from maskwell.llm._shared import crc_mod, drop_path, materialize, table

#: The stages' parameters.
LEAST_POSTERIOR = 0.5
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or of low posterior go."""
    model = language_id.train(docs.select("doc_id", "text", "lang").where(crc_mod("doc_id", 4) != 2))
    return language_id.filter_identified(docs, model, LEAST_POSTERIOR)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.deduplicate(docs, shingle_words=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1])


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, the last one in part."""
    return mixing.emit_mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with slot and shard."""
    return sharding.assign(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language ID fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        if before:
            # the stage is written, so what it read isn't needed any more
            drop_path(spark, before)
        before = path
    return docs
