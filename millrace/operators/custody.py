"""Hash-chained event logs: a serial writer on the driver, verification in Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..session import read_bytes, utc_now, write_bytes

GENESIS = "0" * 64


def event(sequence: int, kind: str, details: dict, prev: str, utc: str) -> dict:
    body = {"sequence": sequence, "utc": utc, "event": kind, "details": details, "prev_sha256": prev}
    return body | {"event_hash": hs.sha256_json(body)}


def append(path: str, kind: str, details: dict, utc: str | None = None) -> dict:
    """Adds one event to a log file; by its nature one after the other."""
    spark = SparkSession.getActiveSession()
    held = read_bytes(spark, path) or b""
    lines = [x for x in held.split(b"\n") if x.strip()]
    last = json.loads(lines[-1]) if lines else {"sequence": -1, "event_hash": GENESIS}
    made = event(last["sequence"] + 1, kind, details, last["event_hash"], utc or utc_now())
    # a log has a few lines a run, and not every file system can append
    write_bytes(spark, path, held + f"{hs.canonical(made)}\n".encode())
    return made


def event_hash() -> object:
    """The hash of an event from its columns; details is canonical JSON already."""
    return F.sha2(hs.canonical_json(
        sequence=(F.col("sequence"), "raw"), utc=F.col("utc"), event=F.col("event"), details=(F.col("details"), "raw"), prev_sha256=F.col("prev_sha256")), 256)


def checked(events: DataFrame, *log: str) -> DataFrame:
    """events (line_no and the CUSTODY columns) with error: hash, link, sequence (in this order) or null.

    Columns named in log tell logs apart; each is verified in its own window, so
    only a single log is one partition.
    """
    order = Window.partitionBy(*log).orderBy("line_no")
    prev = F.coalesce(F.lag("event_hash").over(order), F.lit(GENESIS))
    place = F.row_number().over(order) - 1
    error = F.when(~event_hash().eqNullSafe(F.col("event_hash")), "hash").when(~F.col("prev_sha256").eqNullSafe(prev), "link").when(~F.col("sequence").eqNullSafe(place), "sequence")
    return events.withColumn("error", error)


def verify(events: DataFrame, *log: str) -> DataFrame:
    """events, valid and the first error with its line, for each log; an empty log is valid and has no row here unless log is empty."""
    t = checked(events, *log)
    bad = F.when(F.col("error").isNotNull(), F.col("line_no"))
    return t.groupBy(*log).agg(
        F.count(F.lit(1)).alias("events"), (F.count("error") == 0).alias("valid"), F.min(bad).alias("first_line"), F.min_by("error", bad).alias("first_error"))
