"""A corpus pipeline over documents: STAGES in order, each reading what the one before wrote.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, jaccard_join, secret_forest, source_mix, toxicity
from quern.llm.base import column, release, settle, table, tidy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row with the least doc_id stays; rows without doc_id stay."""
    found = jaccard_join.join_components(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows"))
    found = settle(found.where("doc_id <> least OR rows > 1").select(F.col("doc_id").alias("__copy"), "least", "rows"), "copies")
    same = column(docs, "doc_id", "long") == F.col("__copy")
    out = docs.join(found, same, "left_anti")
    again = found.where("__copy = least AND rows > 1")
    if again.isEmpty():
        return out
    named = next(c for c in docs.columns if c.lower() == "doc_id")
    return out.union(docs.join(again, same, "left_semi").dropDuplicates([named]))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    forest = secret_forest.train(spark)
    tidy(spark)
    return secret_forest.redact(docs, forest)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return source_mix.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return byte_bpe.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("secret_forest", hide_secrets), ("source_mix", mix_sources), ("byte_bpe", encode)]

#: The learned stages are beyond SQL; tests hold each stage against its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's table goes when the next one's stands, the last at the end of the process."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if number:
            release(before)
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
