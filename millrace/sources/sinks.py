"""Tables into files: canonical JSON lines, vault, manifest, index, reports and published tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as hs
from ..session import exists, file_system, write_bytes


def _canonical(value, kind: T.DataType):
    """Canonical JSON of a column of any type, structs by sorted name, nulls kept."""
    if isinstance(kind, T.StructType):
        fields = {f.name: (_canonical(value[f.name], f.dataType), "raw") for f in kind.fields}
        return F.when(value.isNotNull(), hs.canonical_json(**fields)).otherwise("null")
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(_canonical(x, kind.elementType), F.lit("null")))
        return F.when(value.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))).otherwise("null")
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(hs.json_string(e["key"]), F.lit(":"), F.coalesce(_canonical(e["value"], kind.valueType), F.lit("null"))))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", entries), F.lit("}"))).otherwise("null")
    if isinstance(kind, T.StringType):
        return F.coalesce(hs.json_string(value), F.lit("null"))
    return F.coalesce(value.cast("string"), F.lit("null"))


def canonical_lines(df: DataFrame) -> DataFrame:
    """Each row as one line of canonical JSON."""
    whole = hs.canonical_json(**{f.name: (_canonical(F.col(f.name), f.dataType), "raw") for f in df.schema.fields})
    return df.select(whole.alias("value"))


def write_lines(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """Canonical JSON lines; sorted globally by range partitions, or into one file for exchange with files=1."""
    t = df.orderBy(*order) if order else df
    t = canonical_lines(t)
    (t.coalesce(files) if files else t).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_vault(objects: DataFrame, path: str) -> None:
    """(prefix, sha256, content) by prefix; objects that are there already are left alone."""
    spark = objects.sparkSession
    if exists(spark, path):
        there = spark.read.schema("sha256 string, content binary, prefix string").parquet(path)
        objects = objects.join(there.select("sha256"), "sha256", "left_anti")
    objects.select("sha256", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(path)


def manifest_lines(files: DataFrame) -> DataFrame:
    return files.orderBy("relpath").select(F.concat_ws("\t", "sha256", "relpath").alias("value"))


def write_manifest(files: DataFrame, path: str) -> None:
    manifest_lines(files).write.mode("overwrite").text(path)


def write_index(index: DataFrame, path: str) -> None:
    """The CSV index, sorted by sha256, one header in each file."""
    index.orderBy("sha256").write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').csv(path)


def write_text(path: str, value: str) -> None:
    """A small text file, on any file system if a session is active."""
    write_bytes(SparkSession.getActiveSession(), path, value.encode())


def write_json(path: str, value: object) -> None:
    write_text(path, json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False) + "\n")


def lock(spark: SparkSession, path: str) -> None:
    """Makes the files of a published folder read-only, where the file system has permissions."""
    fs, p = file_system(spark, path)
    only = spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("444")
    found = fs.listFiles(p, True)
    while found.hasNext():
        fs.setPermission(found.next().getPath(), only)
