"""Index, census and issue tables, and the audit built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..schemas import OCR_MEDIA


def chunks_per_source(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """sha256 and chunk_count (0 where there is none) of each record."""
    counts = chunks.groupBy(F.col("source_sha256").alias("sha256")).agg(F.count(F.lit(1)).alias("n"))
    return records.select("sha256").join(counts, "sha256", "left").select("sha256", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def index(records: DataFrame, chunks: DataFrame, ocr_status: DataFrame) -> DataFrame:
    """The CSV index: one row per record, in eight columns; order by sha256 when writing.

    chunks is a table of chunks, or of their numbers (sha256, chunk_count) where these are known.
    """
    if "chunk_count" in chunks.columns:
        counts = records.select("sha256").join(chunks.select("sha256", F.col("chunk_count").cast("bigint").alias("n")), "sha256", "left").select("sha256", F.coalesce("n", F.lit(0)).alias("chunk_count"))
    else:
        counts = chunks_per_source(records, chunks)
    t = records.join(counts, "sha256").join(ocr_status.select("sha256", F.col("status").alias("_s")), "sha256", "left")
    first = F.array_min(F.transform("occurrences", lambda o: o["relpath"]))
    return t.select(
        "sha256", "media_type", "size_bytes", F.size("occurrences").cast("bigint").alias("occurrence_count"), tx.csv_guard(first).alias("first_relpath"),
        hs.vault_path(F.col("sha256")).alias("vault_relpath"), F.coalesce("_s", F.lit("n/a")).alias("ocr_status"), "chunk_count")


def ocr_status(bundles: DataFrame) -> DataFrame:
    """sha256 and status of each extracted source: n/a unless it is an image kind, then what came of its recognition."""
    failed = F.exists("parse_warnings", lambda w: w.startswith("ocr_"))
    done = F.when(F.col("ocr_raw_sha256").isNotNull(), "succeeded").when(failed, F.element_at(F.filter("parse_warnings", lambda w: w.startswith("ocr_")), 1)).otherwise("n/a")
    return bundles.select(F.col("source_sha256").alias("sha256"), F.when(F.col("media_type").isin(*OCR_MEDIA), done).otherwise("n/a").alias("status"))


def census(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def warning_census(bundles: DataFrame) -> DataFrame:
    t = bundles.select("media_type", F.explode("parse_warnings").alias("w"))
    return t.groupBy("media_type", tx.warning_class(F.col("w")).alias("warning_class")).agg(F.count(F.lit(1)).alias("n"))


def issues(drops: DataFrame, bundles: DataFrame, utc: str = "", code_tree_sha256: str = "") -> DataFrame:
    """One row per drop reason and per warning class, with a stable fingerprint; no evidence text is taken along."""
    d = drops.groupBy(F.coalesce("reason_code", F.lit("UNKNOWN")).alias("reason_code")).agg(F.count(F.lit(1)).alias("count"))
    d = d.select(F.lit("drop").alias("kind"), "reason_code", "count", hs.fingerprint(F.lit("drop"), F.col("reason_code")).alias("fingerprint"))
    w = warning_census(bundles).withColumnRenamed("n", "count")
    key = F.concat_ws("|", F.coalesce("media_type", F.lit("?")), "warning_class")
    w = w.select(F.lit("parse_warning").alias("kind"), "media_type", "warning_class", "count", hs.fingerprint(F.lit("parse_warning"), key).alias("fingerprint"))
    return d.unionByName(w, allowMissingColumns=True).withColumn("utc", F.lit(utc)).withColumn("code_tree_sha256", F.lit(code_tree_sha256))


def new_issues(harvest: DataFrame, seen: DataFrame) -> DataFrame:
    return harvest.join(seen.select("fingerprint").distinct(), "fingerprint", "left_anti")


def totals(records: DataFrame, drops: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: unique_evidence_objects, total_occurrences, dropped, rag_chunks."""
    r = records.agg(F.count(F.lit(1)).alias("unique_evidence_objects"), F.coalesce(F.sum(F.size("occurrences")), F.lit(0)).alias("total_occurrences"))
    return r.crossJoin(drops.agg(F.count(F.lit(1)).alias("dropped"))).crossJoin(chunks.agg(F.count(F.lit(1)).alias("rag_chunks")))


def documents(bundles: DataFrame, records: DataFrame) -> DataFrame:
    """The published document table; size_bytes is null where the record is missing."""
    sizes = records.select(F.col("sha256").alias("source_sha256"), "size_bytes")
    return bundles.join(sizes, "source_sha256", "left").select(
        F.col("source_sha256").alias("sha256"), "media_type", "channel", "size_bytes", F.size("pages").cast("bigint").alias("pages"),
        F.size("parse_warnings").cast("bigint").alias("parse_warnings"), F.size("tables_meta").cast("bigint").alias("tables"), "subject", "ocr_raw_sha256")


def audit(records: DataFrame, drops: DataFrame, chunks: DataFrame) -> dict:
    """Totals and censuses as one dictionary; a row per media type and reason comes to the driver."""
    out = totals(records, drops, chunks).first().asDict()
    out["media_types"] = {r[0]: r[1] for r in census(records, "media_type").collect()}
    out["drops_by_reason"] = {r[0]: r[1] for r in census(drops, "reason_code").collect()}
    return out


def markdown(audit_: dict) -> str:
    lines = ["# Extraction report", ""]
    for k in ("unique_evidence_objects", "total_occurrences", "dropped", "rag_chunks"):
        lines.append(f"- {k.replace('_', ' ')}: {audit_[k]:,}")
    for head in ("media_types", "drops_by_reason"):
        lines += ["", f"## {head.replace('_', ' ').capitalize()}", "", "| value | n |", "|---|---|"]
        lines += [f"| {k} | {n:,} |" for k, n in sorted(audit_[head].items(), key=lambda x: str(x[0]))]
    return "\n".join(lines) + "\n"
