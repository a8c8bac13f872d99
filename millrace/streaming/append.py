"""Structured Streaming (an extension: the reference has batch look-back and append logs only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reconcile
from ..schemas import struct
from ..session import exists


def merge_stream(spark: SparkSession, source: str, ddl: str, target: str, key: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends rows of arriving JSON files to a Parquet table, each key once.

    Every micro-batch is merged by an anti join with what is published, so a
    batch that is replayed after a failure appends nothing a second time.
    """
    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(batch.schema).parquet(target) if exists(spark, target) else spark.createDataFrame([], batch.schema)
        reconcile.only_new(batch, old, key).write.mode("append").parquet(target)

    stream = spark.readStream.schema(struct(ddl)).json(source)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_usage(events: DataFrame, time: str, model: str, cost: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and cost by window and model of a stream; rows later than `late` are dropped with the state they belong to."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), model).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost")).select(
        F.col("window.start").alias("window_start"), F.col(model), "calls", "cost")
