"""Set tests between ledgers: reconciliation, parity and append-only merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer by key: status match, mismatch, missing (right lacks it) or unlisted (left lacks it)."""
    a = left.select(F.col(key).alias("ka"), F.col(value).alias("va"), F.lit(True).alias("ia"))
    b = right.select(F.col(key).alias("kb"), F.col(value).alias("vb"), F.lit(True).alias("ib"))
    status = F.when(F.col("ib").isNull(), "missing").when(F.col("ia").isNull(), "unlisted").when(F.col("va").eqNullSafe(F.col("vb")), "match").otherwise("mismatch")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias(key), F.col("va").alias("expected"), F.col("vb").alias("actual"), status.alias("status"))


def reconcile(walked: DataFrame, accepted: DataFrame, dropped: DataFrame, key: str = "relpath") -> DataFrame:
    """(key, failure) wherever walked isn't the disjoint union of accepted and dropped; no rows is a pass."""
    mark = lambda df, name: df.select(F.col(key), F.lit(name).alias("side")).distinct()
    sides = mark(walked, "w").union(mark(accepted, "a")).union(mark(dropped, "d"))
    has = lambda s: F.max(F.col("side") == s)
    t = sides.groupBy(key).agg(has("w").alias("w"), has("a").alias("a"), has("d").alias("d"))
    why = F.when(F.col("a") & F.col("d"), "accepted and dropped").when(~F.col("w"), "not walked").when(~F.col("a") & ~F.col("d"), "unaccounted")
    return t.select(key, why.alias("failure")).where("failure IS NOT NULL")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row columns, side) of distinct rows that only one of both has."""
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


def same_multiset(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, left_count, right_count) where two bags differ: one aggregation instead of two EXCEPT ALL."""
    t = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(*keys, F.lit(0), F.lit(1)))
    t = t.groupBy(*keys).agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count"))
    return t.where("left_count <> right_count")


def only_new(batch: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Rows of batch whose key isn't published, once each."""
    return batch.join(published.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def upsert_plan(batch: DataFrame, published: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): insert, same, or conflict - a published object with other bytes, which must stop a merge."""
    b = published.select(F.col(key).alias("_k"), F.col(digest).alias("_d")).distinct()
    action = F.when(F.col("_k").isNull(), "insert").when(F.col(digest) == F.col("_d"), "same").otherwise("conflict")
    return batch.select(key, digest).distinct().join(b, F.col(key) == F.col("_k"), "left").select(key, action.alias("action"))


def with_default(c: Column, value: object) -> Column:
    return F.coalesce(c, F.lit(value))
