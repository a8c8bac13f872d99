"""Merkle roots over sorted hexadecimal digests."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

#: Levels folded by one shuffle: a group of 2 ** FOLD nodes becomes one.
FOLD = 8
EMPTY = hashlib.sha256(b"\0empty").hexdigest()


def _leaf(c: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(c)), 256))


def _pairs(a: Column) -> Column:
    """The next level of an array of nodes; a last one without partner is paired with itself."""
    node = lambda k: F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), F.element_at(a, (2 * k + 1).cast("int")), F.element_at(a, F.least(2 * k + 2, F.size(a)).cast("int"))), 256))
    return F.transform(F.sequence(F.lit(0), ((F.size(a) + 1) / 2).cast("int") - 1), node)


def merkle_root(leaves: DataFrame, digest: str, order: str | None = None) -> DataFrame:
    """One row (root, leaves) for the tree over a column of digests in the order of `order` (by default their own).

    Leaves and inner nodes are hashed with different prefixes.  Each shuffle
    folds FOLD levels, so a billion leaves take four.
    """
    rows, n = numbered(leaves.select(F.col(digest).alias("h"), F.col(order or digest).alias("o")), "o", name="i")
    level = rows.select("i", _leaf(F.col("h")).alias("h"))
    if not n:
        return leaves.sparkSession.createDataFrame([(EMPTY, 0)], "root string, leaves bigint")
    left = math.ceil(math.log2(n)) if n > 1 else 0
    while left:
        fold = min(FOLD, left)
        nodes = F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        group = level.groupBy(F.expr(f"i div {1 << fold}").alias("i")).agg(nodes.alias("a"))
        for _ in range(fold):
            group = group.select("i", _pairs(F.col("a")).alias("a"))
        level = group.select("i", F.col("a")[0].alias("h"))
        left -= fold
    return level.select(F.lower(F.hex("h")).alias("root"), F.lit(n).cast("bigint").alias("leaves"))


def corpus_roots(chunks: DataFrame, documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row with the roots of chunk ids, of document hashes and of manifest lines, and the counts (as text, like a seal has them)."""
    c = merkle_root(chunks, "chunk_id").select(F.col("root").alias("chunks_root"), F.col("leaves").cast("string").alias("chunks"))
    d = merkle_root(documents, "sha256").select(F.col("root").alias("documents_root"), F.col("leaves").cast("string").alias("documents"))
    lines = manifest.select("relpath", F.sha2(F.concat_ws("\t", "sha256", "relpath"), 256).alias("line"))
    m = merkle_root(lines, "line", "relpath").select(F.col("root").alias("manifest_root"))
    return c.crossJoin(d).crossJoin(m).select("chunks_root", "documents_root", "manifest_root", "chunks", "documents")
