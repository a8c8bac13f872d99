"""From candidate files to records, occurrences and drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content as ct
from ..functions import hashing as hs
from ..functions import text as tx
from ..schemas import RunConfig


def judged(candidates: DataFrame, config: RunConfig = RunConfig(), whole_characters: bool = False) -> DataFrame:
    """candidates (relpath, content, size_bytes) with sha256, media_type, magic_label and reason_code (null: accepted).

    A `problem` column, if there is one, carries what listing the files found
    (link, not regular, changed while read); it wins over all other reasons.
    whole_characters: see content.sniff().
    """
    early = F.when(F.col("size_bytes") == 0, "RESOURCE_EMPTY").when(F.col("size_bytes") > config.max_file_bytes, "RESOURCE_TOO_LARGE")
    if "problem" in candidates.columns:
        early = F.coalesce(F.col("problem"), early)
    t = candidates.withColumn("_early", early)
    # what is dropped early isn't looked into
    t = t.withColumn("_kind", F.when(F.col("_early").isNull(), ct.classify(F.col("relpath"), F.col("content"), whole_characters)))
    return t.select(
        *[c for c in candidates.columns if c != "problem"], F.when(F.col("_early").isNull(), F.sha2("content", 256)).alias("sha256"),
        F.col("_kind.media_type").alias("media_type"), F.col("_kind.magic_label").alias("magic_label"), F.coalesce("_early", "_kind.reason").alias("reason_code"))


def changed(judgement: DataFrame, after: DataFrame) -> DataFrame:
    """relpath of each file that was read and has another size or time, or is gone, in a later listing (files.states)."""
    was = judgement.where("sha256 IS NOT NULL").select("relpath", "size_bytes", "mtime_utc")
    now = after.select("relpath", F.col("size_bytes").alias("_size"), F.col("mtime_utc").alias("_mtime"))
    same = F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("mtime_utc").eqNullSafe(F.col("_mtime"))
    return was.join(now, "relpath", "left").where(~same).select("relpath").distinct()


def miscopied(judgement: DataFrame, objects: DataFrame) -> DataFrame:
    """sha256 of accepted content that the vault holds under that address with other bytes."""
    wanted = judgement.where("reason_code IS NULL").select("sha256").distinct()
    return objects.join(wanted, "sha256", "left_semi").where(F.sha2("content", 256) != F.col("sha256")).select("sha256").distinct()


def captured(judgement: DataFrame, changed_: DataFrame, miscopied_: DataFrame) -> DataFrame:
    """The judgement with what capturing found: a change while reading, then a bad copy, go before what the bytes say."""
    t = judgement.join(changed_.withColumn("_changed", F.lit(True)), "relpath", "left").join(miscopied_.withColumn("_bad", F.lit(True)), "sha256", "left")
    found = F.when(F.col("_changed"), "SOURCE_CHANGED_DURING_CAPTURE").when(F.col("_bad"), "TAMPER_COPY_MISMATCH").otherwise(F.col("reason_code"))
    return t.withColumn("reason_code", found).select(*judgement.columns)


def drops(judgement: DataFrame, utc: str) -> DataFrame:
    return judgement.where("reason_code IS NOT NULL").select("relpath", "reason_code", F.coalesce(F.col("magic_label"), F.lit("")).alias("detail"), F.lit(utc).alias("utc"))


def first_in_walk(value: Column, relpath: Column) -> Column:
    return F.min_by(value, F.struct(tx.walk_key(relpath), relpath))


def records(judgement: DataFrame, utc: str) -> DataFrame:
    """One record per distinct content: occurrences in walk order, the first of which decides the media type.

    Only hashes and paths are shuffled, never the content.
    """
    ok = judgement.where("reason_code IS NULL")
    mtime = F.col("mtime_utc") if "mtime_utc" in judgement.columns else F.lit(None).cast("string")
    seen = ok.select("sha256", "relpath", "size_bytes", "media_type", "magic_label", mtime.alias("mtime_utc"))
    one = F.struct("relpath", "size_bytes", "mtime_utc")
    walk = F.struct(tx.walk_key(F.col("relpath")).alias("k"), one.alias("o"))
    return seen.groupBy("sha256").agg(
        F.max("size_bytes").alias("size_bytes"),
        first_in_walk(F.col("media_type"), F.col("relpath")).alias("media_type"),
        first_in_walk(F.col("magic_label"), F.col("relpath")).alias("magic_label"),
        F.transform(F.sort_array(F.collect_list(walk)), lambda x: x["o"]).alias("occurrences"),
    ).select("sha256", "size_bytes", "media_type", "magic_label", hs.vault_path(F.col("sha256")).alias("vault_relpath"), "occurrences", F.lit(utc).alias("captured_utc"))


def vault(judgement: DataFrame) -> DataFrame:
    """(prefix, sha256, content), each content once: partition by prefix when writing."""
    ok = judgement.where("reason_code IS NULL")
    return ok.select("sha256", "content").dropDuplicates(["sha256"]).select(F.substring("sha256", 1, 2).alias("prefix"), "sha256", "content")


def relpaths(occurrences: Column) -> Column:
    return F.sort_array(F.transform(occurrences, lambda o: o["relpath"]))


def duplicate_groups(records_: DataFrame) -> DataFrame:
    return records_.where(F.size("occurrences") > 1).select("sha256", F.size("occurrences").cast("bigint").alias("copies"), relpaths(F.col("occurrences")).alias("relpaths"))
