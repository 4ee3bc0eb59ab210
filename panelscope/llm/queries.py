"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from . import (
    contamination, lines, neardup, packing, periodic, pii, quality_rules, reference_sql, repeats, secret_scan,
    sharding, toxicity, vector_codes, weak_labels,
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.weak_quality(read_table(spark, sf_dir, "documents"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op4_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source's documents of one language are a repository
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return secret_scan.secrets(read_table(spark, sf_dir, "documents"), F.col("source"), repository)


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"), "kept")


def packed(docs: DataFrame) -> DataFrame:
    """Packed by the 50 k byte-level vocabulary."""
    import public_tokenizers

    return packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        special=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op9_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    ).drop("text_key")


def op10_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read_table(spark, sf_dir, "documents"))


def op12_value_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read_table(spark, sf_dir, "embeddings")).drop("label")


def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(read_table(spark, sf_dir, "documents"), periodic.planted)


def llm_queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def llm_oracle_sql() -> dict[str, str]:
    """Only what plain SQL can say; the other operators are tested by brute force."""
    return {
        "op1_dart_minhash": reference_sql.NEAR_DUPLICATES, "op4_owned_secrets": reference_sql.SECRETS,
        "op5_fuzzy_lines": reference_sql.LINE_CLASSES,
        "op8_contextual_pii": reference_sql.PERSONAL_DATA, "op9_containment": reference_sql.CONTAINMENT,
        "op11_interval_tree_repeats": reference_sql.REPEATS, "op12_value_dictionary_codes": reference_sql.vector_codes(),
    }
