"""Session and runtime helpers used by every subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults (UTC, ANSI, adaptive execution).

    On a cluster leave master and partitions unset: both then come from
    spark-submit, and adaptive execution sizes the shuffles.
    """
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    prepare(spark)
    return spark


#: Arrow batches to and from Python hold at most about this many bytes, of long texts and recordings too.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and keep their batches small."""
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's own value: whoever set another keeps it
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) may the setting be absent:
    then a temporary folder is made and removed at exit.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, given, True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(given)
    return given


#: A file of fewer bytes than this may have too few row groups for all cores; on clusters of any size the same.
SPREAD_BYTES = 64 << 20


def utc_now() -> str:
    """ISO text with microseconds."""
    return datetime.now(UTC).isoformat(timespec="microseconds")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a small one in few files is spread by rows.

    All others are read as they lie, without a shuffle.
    """
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    fs, p = file_system(spark, path)
    size = fs.getContentSummary(p)
    return df.repartition(cores) if 1 << 20 < size.getLength() < SPREAD_BYTES and size.getFileCount() < cores else df


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that a path or URI lies on, and the path qualified by it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file sources name it: with scheme and authority."""
    return file_system(spark, path)[1].toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def local_path(path: str) -> str | None:
    """The path itself, or that of a file: URI; None for other file systems."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file whole, from any file system; None if there is none."""
    if own := local_path(path):
        return Path(own).read_bytes() if os.path.exists(own) else None
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, value: bytes) -> None:
    """A small file whole, to any file system."""
    if own := local_path(path):
        Path(own).parent.mkdir(parents=True, exist_ok=True)
        Path(own).write_bytes(value)
        return
    fs, p = file_system(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(value))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever file system it lies on."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
