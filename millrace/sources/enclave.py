"""Recognition on a host without a network: requests go out as a table with a manifest, responses come back as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..operators.reconcile import compare
from ..schemas import OCR_MEDIA
from ..session import exists
from . import files, sinks


class Tampered(RuntimeError):
    """Requests that aren't what the manifest says."""


def export(records: DataFrame, objects: DataFrame, folder: str) -> int:
    """Writes the objects of image kinds (sha256, content) and a manifest of them; returns their number."""
    spark, folder = records.sparkSession, folder.rstrip("/")
    wanted = objects.join(records.where(F.col("media_type").isin(*OCR_MEDIA)).select("sha256"), "sha256", "left_semi")
    wanted.select("sha256", "content").write.mode("overwrite").parquet(f"{folder}/requests")
    sent = spark.read.schema("sha256 string, content binary").parquet(f"{folder}/requests")
    listed = sent.select(F.sha2("content", 256).alias("sha256"), hs.vault_path(F.col("sha256")).alias("relpath"))
    sinks.write_manifest(listed, f"{folder}/manifest")
    return sent.count()


def responses(spark: SparkSession, records: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(source_sha256, raw) of responses/<sha256>.json, and the status of every record.

    Every exported request must still hash to its line of the manifest, and
    none may be missing or added; a response that isn't JSON fails the job.
    """
    folder = folder.rstrip("/")
    sent = spark.read.schema("sha256 string, content binary").parquet(f"{folder}/requests")
    now = sent.select(F.sha2("content", 256).alias("sha256"), hs.vault_path(F.col("sha256")).alias("relpath"))
    wrong = compare(files.manifest(spark, f"{folder}/manifest"), now, "relpath", "sha256").where("status <> 'match'").limit(5).collect()
    if wrong:
        raise Tampered(f"requests differ from their manifest, first {wrong[0]['relpath']}")
    scans = records.where(F.col("media_type").isin(*OCR_MEDIA)).select(F.col("sha256").alias("source_sha256"))
    got = spark.createDataFrame([], "source_sha256 string, raw string")
    if exists(spark, f"{folder}/responses"):
        name = F.regexp_extract("_metadata.file_name", r"^([0-9a-f]{64})\.json$", 1)
        raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{folder}/responses").select(name.alias("source_sha256"), F.col("value").alias("raw"))
        whole = F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("no JSON: response "), "source_sha256")))
        got = raw.join(scans, "source_sha256", "left_semi").withColumn("raw", whole)
    answered = got.select(F.col("source_sha256").alias("sha256"), F.lit(True).alias("answered"))
    status = F.when(~F.col("media_type").isin(*OCR_MEDIA), "not_applicable").when(F.col("answered"), "succeeded").otherwise("ocr_unavailable")
    return got, records.join(answered, "sha256", "left").select("sha256", status.alias("status"))
