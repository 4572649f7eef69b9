"""The queries opN_<name> and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, hash_index, iblt, jaccard_join, quote_links, secret_forest, shard_tree, source_mix, toxicity, url_reputation
from .base import table


def op1_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_index.nearest(table(spark, sf_dir, "embeddings"))


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.threads(table(spark, sf_dir, "conversations"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), url_reputation.outcomes_from_labels(table(spark, sf_dir, "labels")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("draw")


def op5_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard_documents(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"), secret_forest.train(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"op3_host_reputation": url_reputation.sql(), "op4_source_mix": source_mix.sql()}
