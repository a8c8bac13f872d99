"""Helpers the operators share: durable cuts of lineage, bounded label samples, row filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import prepare, shared_folder
from . import textcore as tc

__all__ = ["cut", "fresh", "bounded_texts", "labelled_sample", "keep_rows", "ready", "broadcast_if_small"]


def ready(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    prepare(spark)
    shared_folder(spark)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or with as many underscores as it takes for df to have no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, limit_bytes: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit limit_bytes; else as it is (a shuffle join)."""
    fits = df.limit(limit_bytes // row_bytes + 1).count() <= limit_bytes // row_bytes
    return F.broadcast(df) if fits else df


#: Text of a training sample that the driver takes in, for each class.
SAMPLE_BYTES = 48 << 20


def bounded_texts(docs: DataFrame, chosen: DataFrame, max_bytes: int) -> list[tuple[str, object]]:
    """(text, y) of the documents that chosen (id, y, at) names, in the order of (at, id).

    The tables are cut down before the driver takes anything in: of several
    texts under one id one counts (that of the least hash), and of each y
    documents are taken in order until the next would bring their texts beyond
    max_bytes.  chosen is bounded by its maker, and is broadcast.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("words")).where("words IS NOT NULL AND words <> ''")
    named = texts.join(F.broadcast(chosen), "id").withColumn("hash", F.xxhash64("words")).withColumn("size", F.octet_length("words"))
    # first which texts, by their hashes alone; then those texts
    one = named.groupBy("id", "y", "at").agg(F.min(F.struct("hash", "size")).alias("least"))
    total = F.sum("least.size").over(Window.partitionBy("y").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = one.withColumn("total", total).where(F.col("total") <= max_bytes).select("id", "y", "at", F.col("least.hash").alias("hash"))
    rows = texts.withColumn("hash", F.xxhash64("words")).join(F.broadcast(kept), ["id", "hash"]).groupBy("id", "y", "at").agg(F.min("words").alias("words"))
    rows = rows.toArrow().sort_by([("at", "ascending"), ("id", "ascending"), ("y", "ascending")])
    return list(zip(rows["words"].to_pylist(), rows["y"].to_pylist()))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, seed: int, max_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """(text, class) of at most per_class labelled documents of each class 0 and 1, and at most max_bytes of text a class.

    The choice is by a seeded hash of doc_id, so it neither follows the tables'
    order nor changes with their partitioning.  Labels that are null, that
    contradict each other for one doc_id, or whose document is absent or has no
    text are left out; a repeated document counts once.
    """
    one = (
        labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)")
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top").select("id", "y", F.xxhash64("id", F.lit(seed)).alias("at"))
    )
    chosen = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy("at", "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * per_class rows of three numbers, whatever the tables' size
    return bounded_texts(docs, cut(chosen), max_bytes)


def keep_rows(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray], column: str = "text") -> DataFrame:
    """The rows for whose text decide (over Arrow strings) is true; every column passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.steps(batch, column):
                yield part.filter(pa.array(decide(tc.column(part, column)), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
