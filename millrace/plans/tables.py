"""The test tables seen as inputs of the operators: documents as files, events as usage, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import hashing as hs
from ..operators import chunking


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return session.read(spark, f"{sf_dir}/{table}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as accepted text files source/doc_id.txt."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relpath"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"), F.lit("txt").alias("media_type"), F.lit("txt").alias("magic_label"), F.lit(None).cast("string").alias("reason_code"))


def pieces(spark: SparkSession, sf_dir: str, target: int = 2000, overlap: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of documents as native text without page numbers; their extraction hash is the text's."""
    d = read(spark, sf_dir, "documents").select("doc_id", *carry, F.sha2("text", 256).alias("source_sha256"), "text")
    t = chunking.pieces(d, "text", target, overlap)
    made = hs.chunk_id(
        F.col("source_sha256"), F.col("source_sha256"), F.lit(hs.chunk_config_sha(target, overlap)), F.lit("native-text"), F.lit(None).cast("int"),
        F.col("char_start"), F.col("char_end"), F.col("text_sha256"))
    return t.withColumn("chunk_id", made)


MODELS = {"click": "Swift-Mini-2", "view": "sonnet-4", "purchase": "opus-5", "signup": "gpt-5.4"}


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as usage: the type is the model (error: none), the value makes tokens and cost."""
    e = read(spark, sf_dir, "events")
    model = F.lit(None).cast("string")
    for kind, name in MODELS.items():
        model = F.when(F.col("event_type") == kind, name).otherwise(model)
    part = lambda x: F.floor(F.col("value") * F.lit(float(x))).cast("bigint")
    return e.select(
        model.alias("model"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("call"), F.col("user_id").cast("string"))).alias("parent_tool_call_id"),
        F.when(F.col("user_id") % 2 == 0, F.lit(None)).otherwise(F.when(F.col("user_id") % 9 == 0, "").otherwise("agent")).alias("agent_id"),
        part(100).alias("input_tokens"), F.when(F.col("event_id") % 7 > 0, part(60)).alias("cache_read_tokens"), F.when(F.col("event_id") % 5 > 0, part(50)).alias("cache_write_tokens"),
        part(10).alias("output_tokens"), part(1000).alias("total_nano_aiu"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))


def dispatch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines: session and value.  Some are malformed, some aren't task requests, some lack or null a field."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 11
    name = F.when(k == 0, "grep").otherwise("task")
    agent = F.when(k == 1, "").when(k == 2, '"agent_type":null,').otherwise(F.concat(F.lit('"agent_type":"'), F.when(k < 6, "explore").when(k < 9, "task").otherwise("review"), F.lit('",')))
    model = F.lit("")
    for kind, m in MODELS.items():
        model = F.when(F.col("event_type") == kind, f'"model":"{m}",').otherwise(model)
    line = F.concat(F.lit('{"data":{"toolRequests":[{"name":"'), name, F.lit('","arguments":{'), agent, model, F.lit('"n":'), F.col("user_id").cast("string"), F.lit("}}]}}"))
    line = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"task":'), line)).otherwise(line)
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("session"), line.alias("value"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as five event chains, one per region; those of regions 1 to 3 are tampered with.

    A chain is folded over its sorted events inside one expression.
    """
    n = read(spark, sf_dir, "nation")
    by = n.groupBy(F.col("n_regionkey").alias("log")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("e"))
    details = lambda x: hs.canonical_json(nation=x["n_name"])

    def step(acc, x):
        body = hs.canonical_json(
            sequence=(F.size(acc["a"]), "raw"), utc=F.lit("2024-01-01"), event=F.lit("nation"), details=(details(x), "raw"), prev_sha256=acc["h"])
        made = F.struct(details(x).alias("details"), acc["h"].alias("prev_sha256"), F.sha2(body, 256).alias("event_hash"))
        return F.struct(F.array_append(acc["a"], made).alias("a"), F.sha2(body, 256).alias("h"))

    empty = F.array().cast("array<struct<details:string,prev_sha256:string,event_hash:string>>")
    folded = by.select("log", F.aggregate("e", F.struct(empty.alias("a"), F.lit("0" * 64).alias("h")), step, lambda acc: acc["a"]).alias("a"))
    t = folded.select("log", F.posexplode("a").alias("line_no", "x"))
    spoilt = F.when((F.col("log") == 1) & (F.col("line_no") == 2), '{"nation":"NOWHERE"}').otherwise(F.col("x.details"))
    t = t.where("NOT (log = 2 AND line_no = 1)")  # a lost event breaks the link after it
    return t.select(
        "log", "line_no", F.when((F.col("log") == 3) & (F.col("line_no") == 3), 7).otherwise(F.col("line_no")).cast("bigint").alias("sequence"), F.lit("2024-01-01").alias("utc"),
        F.lit("nation").alias("event"), spoilt.alias("details"), F.col("x.prev_sha256").alias("prev_sha256"), F.col("x.event_hash").alias("event_hash"))
