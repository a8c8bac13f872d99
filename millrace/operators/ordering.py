"""Global row numbers and systematic samples without a one-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *keys: str, name: str = "row_no") -> tuple[DataFrame, int]:
    """df with row numbers from 0 in the order of keys (ties as they come), and the number of rows.

    Rows are range-partitioned; each partition numbers its own from the sum of
    the sizes of those before it.  The ranges are cut into a checkpoint, so
    sizes and numbers see the same ones.
    """
    ranged = cut(df.repartitionByRange(*map(F.col, keys)).withColumn("_part", F.spark_partition_id()))
    at, starts = 0, []
    for part, n in sorted(ranged.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _first bigint")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + own - 1).drop("_part", "_first"), at


def systematic_sample(df: DataFrame, *keys: str, size: int = 2000) -> DataFrame:
    """Every (n // size)-th row in the order of keys, from the first; all rows when there are fewer than 2 * size."""
    rows, n = numbered(df, *keys, name="line_no")
    step = max(1, n // size)
    return rows.where(F.col("line_no") % step == 0)
