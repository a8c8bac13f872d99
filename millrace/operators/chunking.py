"""Overlapping chunks with re-derivable identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..schemas import ENGINE_VERSION, SCHEMA_VERSION


def spans(df: DataFrame, text: str = "text", target: int = 2000, overlap: int = 200) -> DataFrame:
    """df with one row per window of its text: char_start, char_end.  Narrow: no shuffle."""
    return df.select("*", F.inline(tx.window_spans(F.col(text), target, overlap)).alias("char_start", "char_end"))


def pieces(df: DataFrame, text: str = "text", target: int = 2000, overlap: int = 200) -> DataFrame:
    """spans() with the piece, its UTF-8 byte range and its hash, without blank pieces; the text itself is dropped."""
    t = df.select("*", F.inline(tx.window_pieces(F.col(text), target, overlap)).alias("char_start", "char_end", "utf8_byte_start", "piece")).drop(text)
    t = t.where(~tx.is_blank(F.col("piece")))
    return t.withColumn("utf8_byte_end", F.col("utf8_byte_start") + F.octet_length("piece")).withColumn("text_sha256", F.sha2("piece", 256))


def counted(df: DataFrame, text: str = "text", target: int = 2000, overlap: int = 200) -> DataFrame:
    """df with the number and the characters of its text's pieces (blank ones left out) instead of the text: a row stays a row, and nothing moves."""
    made = F.filter(tx.window_pieces(F.col(text), target, overlap), lambda x: ~tx.is_blank(x["piece"]))
    sizes = F.coalesce(F.transform(made, lambda x: F.length(x["piece"])), F.array().cast("array<int>"))
    t = df.withColumn("_sizes", sizes).drop(text)
    total = F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.withColumn("chunk_count", F.size("_sizes")).withColumn("chunk_chars", total).drop("_sizes")


def chunks(bundles: DataFrame, records: DataFrame, run_id: str, target: int = 2000, overlap: int = 200, code_tree_sha256: str = "") -> DataFrame:
    """All chunks of bundles (with extraction_sha256) whose record is given."""
    names = records.select(
        F.col("sha256").alias("source_sha256"), F.sort_array(F.transform("occurrences", lambda o: o["relpath"])).alias("source_relpaths"))
    pages = bundles.select("source_sha256", "media_type", "channel", "extraction_sha256", F.inline("pages").alias("page_number", "page_text"))
    t = pieces(pages, "page_text", target, overlap).join(names, "source_sha256")
    config = F.lit(hs.chunk_config_sha(target, overlap))
    made = hs.chunk_id(
        F.col("source_sha256"), F.col("extraction_sha256"), config, F.col("channel"), F.col("page_number"), F.col("char_start"), F.col("char_end"), F.col("text_sha256"))
    placeholder = F.struct(
        F.lit("not_generated").alias("state"), F.lit(None).cast("string").alias("model_id"), F.lit(None).cast("int").alias("dim"), F.lit(None).cast("array<double>").alias("vector"))
    return t.select(
        made.alias("chunk_id"), "source_sha256", "source_relpaths", "media_type", "channel", "page_number", "char_start", "char_end", "utf8_byte_start", "utf8_byte_end",
        F.col("piece").alias("text"), "text_sha256", "extraction_sha256", config.alias("chunk_config_sha256"), F.lit(ENGINE_VERSION).alias("tool_version"),
        F.lit(code_tree_sha256).alias("code_tree_sha256"), F.lit(run_id).alias("run_id"), placeholder.alias("embedding"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )
