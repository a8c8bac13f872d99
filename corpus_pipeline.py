"""A corpus pipeline of five operators of millrace.llm.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns the columns of documents; the last returns the shard index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace import session
from millrace.llm import mixing, sharding, simhash, toxicity, winnowing


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 13 words or more with a benchmark item go."""
    return winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights."""
    return mixing.mix(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each copy lies in the corpus, and in which shard."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Toxicity, near-dedup and decontamination aren't expressible in SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents.

    What a stage keeps is written to the shared folder and read again, so that
    none is worked out twice and a lost executor costs its own tasks only; the
    table before is then removed.
    """
    folder = f"{session.shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = session.read(spark, f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = session.read(spark, f"{folder}/{k}")
        if before:
            session.delete(spark, before)
        before = f"{folder}/{k}"
    shards = STAGES[-1][1](spark, docs, sf_dir)
    # sharding has read its input by now: the result hangs on a checkpoint of the keys alone
    session.delete(spark, folder)
    return shards
