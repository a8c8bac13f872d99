"""Checks that yield failure rows (check, subject, detail); a stage passes when there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..schemas import MEDIA_TYPES, is_sha256, schema_violations
from . import merkle
from .reconcile import compare, same_multiset

FAILURE = "check string, subject string, detail string"


def _fail(df: DataFrame, check: str, subject: str, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def vault(objects: DataFrame) -> DataFrame:
    """Objects (sha256, content) that don't hash to their address."""
    actual = F.sha2("content", 256)
    return _fail(objects.where(~is_sha256(F.col("sha256")) | (actual != F.col("sha256"))), "vault_hash", "sha256", actual)


def missing_objects(records: DataFrame, objects: DataFrame) -> DataFrame:
    return _fail(records.join(objects.select("sha256"), "sha256", "left_anti"), "vault_missing", "sha256", F.lit("no object"))


def sources(occurrences: DataFrame, fresh: DataFrame) -> DataFrame:
    """Recorded occurrences (relpath, sha256) against a fresh scan's (relpath, sha256)."""
    t = compare(occurrences, fresh, "relpath", "sha256").where("status IN ('missing', 'mismatch')")
    return _fail(t, "source_hash", "relpath", F.col("status"))


def paths(records: DataFrame) -> DataFrame:
    t = records.select("sha256", F.explode("occurrences.relpath").alias("relpath"))
    return _fail(t.where(tx.path_is_unsafe(F.col("relpath"))), "path", "sha256", F.col("relpath"))


def vocabulary(records: DataFrame) -> DataFrame:
    return _fail(records.where(~F.col("media_type").isin(*MEDIA_TYPES)), "media_type", "sha256", F.col("media_type"))


def reparse(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Stored native-text pages against those of a second extraction."""
    a = stored.where("channel = 'native-text'").select("source_sha256", F.col("pages").alias("p"))
    b = again.select("source_sha256", F.col("pages").alias("q"))
    return _fail(a.join(b, "source_sha256", "left").where(~F.col("p").eqNullSafe(F.col("q"))), "reparse", "source_sha256", F.lit("pages differ"))


def rederived(chunks: DataFrame, bundles: DataFrame) -> DataFrame:
    """chunks with error: no_bundle, no_page, text, text_hash or chunk_id - the first that holds - or null.

    bundles carry extraction_sha256.  Pages are matched null-safe by number; of
    pages with one number the last counts.
    """
    pages = bundles.select("source_sha256", F.posexplode("pages").alias("pos", "page"))
    last = pages.groupBy("source_sha256", F.col("page.page_number").alias("pn")).agg(F.max_by("page.text", "pos").alias("page_text"))
    known = bundles.select("source_sha256", F.col("extraction_sha256").alias("_ex"), F.lit(True).alias("_known"))
    t = chunks.join(known, "source_sha256", "left")
    p = last.withColumnRenamed("source_sha256", "_src")
    t = t.join(p, (F.col("source_sha256") == F.col("_src")) & F.col("page_number").eqNullSafe(F.col("pn")), "left")
    piece = F.substring(F.col("page_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    made = hs.chunk_id(
        F.col("source_sha256"), F.col("_ex"), F.col("chunk_config_sha256"), F.col("channel"), F.col("page_number"), F.col("char_start"), F.col("char_end"), F.col("text_sha256"))
    error = (
        F.when(F.col("_known").isNull(), "no_bundle").when(F.col("_src").isNull(), "no_page").when(~piece.eqNullSafe(F.col("text")), "text")
        .when(F.sha2("text", 256) != F.col("text_sha256"), "text_hash").when(made != F.col("chunk_id"), "chunk_id"))
    return t.withColumn("error", error).drop("_ex", "_known", "_src", "pn", "page_text")


def chunk_failures(chunks: DataFrame, bundles: DataFrame) -> DataFrame:
    return _fail(rederived(chunks, bundles).where("error IS NOT NULL"), "chunk", "chunk_id", F.col("error"))


def orphans(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """Chunks whose source object isn't there."""
    t = chunks.join(objects.select(F.col("sha256").alias("source_sha256")), "source_sha256", "left_anti")
    return _fail(t, "orphan_chunk", "chunk_id", F.col("source_sha256"))


def manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    t = compare(listed, found, "relpath", "sha256").where("status <> 'match'")
    return _fail(t, "manifest", "relpath", F.col("status"))


def seal(sealed: DataFrame, chunks: DataFrame, documents: DataFrame, listed: DataFrame) -> DataFrame:
    """The sealed row of roots and counts against re-derived ones."""
    made = merkle.corpus_roots(chunks, documents, listed)
    names = made.columns
    row = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in names))).alias("x")).select("x.*")
    t = compare(row(sealed), row(made), "k", "v").where("status <> 'match'")
    return _fail(t, "seal", "k", F.col("actual"))


def id_parity(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Two layers must hold the same bag of ids."""
    return _fail(same_multiset(a, b, key), "id_parity", key, F.concat_ws(" / ", "left_count", "right_count"))


def missing_bundles(records: DataFrame, bundles: DataFrame) -> DataFrame:
    """Records that were never extracted: without this they would silently give no chunks."""
    t = records.join(bundles.select(F.col("source_sha256").alias("sha256")), "sha256", "left_anti")
    return _fail(t, "bundle_missing", "sha256", F.col("media_type"))


def published_ids(chunks: DataFrame) -> DataFrame:
    """Published chunks whose id doesn't follow from what is published of them."""
    made = hs.chunk_id(
        F.col("source_sha256"), F.col("extraction_sha256"), F.col("chunk_config_sha256"), F.col("channel"), F.col("page_number"), F.col("char_start"), F.col("char_end"), F.col("text_sha256"))
    return _fail(chunks.where(~made.eqNullSafe(F.col("chunk_id"))), "chunk_id", "chunk_id", made)


def closed(lines: DataFrame, ddl: str) -> DataFrame:
    """JSON lines outside a schema: unknown names, ill-typed values, no object."""
    t = schema_violations(lines, ddl).where("NOT valid").withColumn("line", F.sha2("value", 256))
    return _fail(t, "schema", "line", F.concat_ws(", ", "unknown"))


def text_hashes(chunks: DataFrame) -> DataFrame:
    return _fail(chunks.where(F.sha2("text", 256) != F.col("text_sha256")), "text_hash", "chunk_id", F.col("text_sha256"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview(failures: DataFrame, n: int = 50) -> DataFrame:
    """The first n failures of a report."""
    return failures.orderBy("check", "subject", "detail").limit(n)
