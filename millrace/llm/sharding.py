"""Balanced contiguous shards by global prefix sums of byte sizes (operator 9).

Only keys are moved: (doc_id, bytes) is range-partitioned by doc_id, each
partition's total is added up, and the totals' running sum gives every
partition the offset at which its own running sum starts.  No global sort of
one partition is needed, and the driver sees one number per partition.  The
ranges are cut into a checkpoint first, so that both passes see the same ones
even if an executor is lost between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready

SHARD_BYTES = 64 << 20


def shard(docs: DataFrame, shard_bytes: int | None = SHARD_BYTES, shards: int | None = None, partitions: int | None = None) -> DataFrame:
    """doc_id, n_bytes, byte_start, position and shard of every row, in the order of doc_id.

    byte_start is the number of bytes of all texts before this one, position
    that of rows.  With `shards` the total is cut into so many equal parts,
    otherwise into ceil(total / shard_bytes); a text belongs to the shard in
    which its first byte lies, so no shard exceeds its target by more than one
    text.  Null doc_ids come first; rows of one doc_id are ordered by size, and
    rows that agree in both are alike in the result.  Null texts have 0 bytes.
    An empty table gives an empty result, texts of no bytes at all one shard.
    """
    spark = ready(docs)
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(keys.repartitionByRange(parts, "doc_id", "n_bytes").withColumn("part", F.spark_partition_id()))
    totals = sorted(ranged.groupBy("part").agg(F.sum("n_bytes"), F.count(F.lit(1))).collect())
    offsets, at, rows = [], 0, 0
    for part, size, n in totals:
        offsets.append((part, at, rows))
        at, rows = at + size, rows + n
    number = shards or max(1, -(-at // shard_bytes))
    starts = spark.createDataFrame(offsets, "part int, offset bigint, first bigint")
    order = Window.partitionBy("part").orderBy("doc_id", "n_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(starts), "part")  # one row per partition
    placed = placed.withColumn("byte_start", F.col("offset") + F.sum("n_bytes").over(order) - F.col("n_bytes"))
    placed = placed.withColumn("position", F.col("first") + F.count(F.lit(1)).over(order) - 1)
    # byte_start * number would leave 64 bits at 100 TB and many shards; a decimal doesn't, and div is exact where a quotient would be rounded
    cell = F.lit(0).cast("bigint")
    if at:
        cell = F.least(F.expr(f"(cast(byte_start AS decimal(38,0)) * {number}BD) div {at}BD"), F.lit(number - 1))
    return placed.select("doc_id", "n_bytes", "byte_start", "position", cell.cast("bigint").alias("shard"))
