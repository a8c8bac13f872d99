"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import session
from . import audio, fixity, langid, mixing, nbsvm, sharding, simhash, suffixes, toxicity, winnowing


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return session.read(spark, f"{sf_dir}/{table}.parquet")


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages against a replica with planted damage (see fixity.damaged)."""
    pages = _read(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.damaged(pages))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_read(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_read(spark, sf_dir, "documents"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings made audible (see audio.sonify): there is no table of recordings."""
    return audio.features(audio.sonify(_read(spark, sf_dir, "embeddings")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))




def op10_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return nbsvm.classify(docs, nbsvm.train(docs, _read(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fixity, op2_decontamination, op3_suffixes, op4_mixing, op5_langid,
        op6_simhash, op7_audio, op8_toxicity, op9_sharding, op10_nbsvm,
    )
}

_REPLICA = """
        WITH b AS (SELECT page_id, url, html, substr(md5(page_id::VARCHAR), 1, 2) AS byte FROM pages),
        act AS (SELECT page_id, url, CASE WHEN byte = '00' THEN chr(0) || substr(html, 2) ELSE html END AS html FROM b WHERE byte <> '01'
                UNION ALL SELECT -1 - page_id, url, html FROM b WHERE byte = '02'),
        both_ AS (SELECT 'e' AS side, page_id, url, html FROM pages UNION ALL SELECT 'a', page_id, url, html FROM act),
        rec AS (SELECT side, page_id, floor(page_id / 4096.0)::BIGINT AS file,
                'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)
                || html || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM both_),
        dig AS (SELECT side, page_id, file, sha256(r) AS digest, strlen(r) AS n, sum(strlen(r)) OVER (PARTITION BY side, file ORDER BY page_id) - strlen(r) AS off FROM rec)
"""

ORACLES = {
    "op1_fixity": _REPLICA + """
        SELECT coalesce(e.page_id, a.page_id) AS page_id, coalesce(e.file, a.file) AS file,
               CASE WHEN a.digest IS NULL THEN 'missing' WHEN e.digest IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
               coalesce(e.off, a.off)::BIGINT AS byte_offset, coalesce(e.n, a.n)::BIGINT AS n_bytes, e.digest AS expected_digest, a.digest AS actual_digest
        FROM (SELECT * FROM dig WHERE side = 'e') e FULL JOIN (SELECT * FROM dig WHERE side = 'a') a ON e.page_id = a.page_id
        WHERE e.digest IS NULL OR a.digest IS NULL OR e.digest <> a.digest""",
    "op4_mixing": """
        WITH sizes AS (SELECT source, sum(coalesce(n_chars, 0))::DOUBLE AS size FROM documents GROUP BY source),
        t AS (SELECT source, size, CASE WHEN sqrt(size) > 0 THEN sqrt(size) ELSE 0 END AS weight FROM sizes),
        caps AS (SELECT *, CASE WHEN weight > 0 THEN size * 4.0 ELSE 0 END AS cap, CASE WHEN weight > 0 THEN size * 4.0 / weight ELSE 0 END AS full_at FROM t),
        b AS (SELECT *, least(sum(size) OVER (), sum(cap) OVER ()) AS budget FROM caps),
        lev AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / nullif(sum(weight) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lv FROM b),
        w AS (SELECT min(lv) AS water FROM (SELECT lv FROM lev WHERE full_at > lv ORDER BY full_at, source LIMIT 1) q),
        plan AS (SELECT source, CASE WHEN size > 0 THEN (CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END) / size ELSE 0 END AS epochs FROM lev CROSS JOIN w),
        drawn AS (SELECT d.doc_id, d.source, floor(p.epochs)::BIGINT + CASE WHEN
                   CAST('0x' || substr(md5('4:' || d.doc_id::VARCHAR), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 < p.epochs - floor(p.epochs) THEN 1 ELSE 0 END AS copies
                  FROM documents d JOIN plan p ON d.source = p.source)
        SELECT doc_id, source, c.copy AS copy FROM drawn JOIN (SELECT unnest(range(1, 6)) AS copy) c ON c.copy <= drawn.copies""",
    "op9_sharding": """
        WITH s AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents),
        p AS (SELECT doc_id, n_bytes, sum(n_bytes) OVER (ORDER BY doc_id, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_bytes AS byte_start,
              row_number() OVER (ORDER BY doc_id, n_bytes) - 1 AS position, sum(n_bytes) OVER () AS total FROM s),
        q AS (SELECT *, greatest(1, (total + 67108863) // 67108864) AS shards FROM p)
        SELECT doc_id, n_bytes::BIGINT AS n_bytes, byte_start::BIGINT AS byte_start, position::BIGINT AS position,
               least((byte_start * shards) // total, shards - 1)::BIGINT AS shard FROM q""",
}
