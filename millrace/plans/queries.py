"""Registered queries over the test tables, one or more per group of operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content, markup
from ..functions import hashing as hs
from ..functions import text as tx
from ..operators import chunking, custody, decisions, intake, merkle, ordering, reconcile, reports, usage, validate
from ..schemas import schema_violations
from . import tables as tb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIRST_DATE = "2024-01-23"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _path(alias: str = "") -> str:
    return f"{alias}source || '/' || {alias}doc_id::VARCHAR || '.txt'"


# content addressing


@query(f"""SELECT sha256(text) AS sha256, count(*)::BIGINT AS copies, max(strlen(text))::BIGINT AS size_bytes,
          list_aggregate(list_sort(list({_path()})), 'string_agg', '|') AS relpaths, min({_path()}) AS first_relpath FROM documents GROUP BY sha256(text)""")
def dedup_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = intake.records(intake_rows(spark, sf_dir), "2024-01-01")
    return t.select(
        "sha256", F.size("occurrences").cast("bigint").alias("copies"), "size_bytes", F.array_join(intake.relpaths(F.col("occurrences")), "|").alias("relpaths"),
        F.array_min(intake.relpaths(F.col("occurrences"))).alias("first_relpath"))


def intake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.judged(spark, sf_dir)


@query(f"""SELECT sha256(text) AS sha256, count(*)::BIGINT AS copies, list_aggregate(list_sort(list({_path()})), 'string_agg', '|') AS relpaths
           FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = intake.duplicate_groups(intake.records(intake_rows(spark, sf_dir), ""))
    return t.withColumn("relpaths", F.array_join("relpaths", "|"))


_VAULT = "'evidence/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text)"


@query(f"SELECT DISTINCT sha256(text) AS sha256, {_VAULT} AS vault_relpath, strlen(text)::BIGINT AS size_bytes FROM documents")
def vault_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = intake_rows(spark, sf_dir).select("sha256", "size_bytes").distinct()
    return t.select("sha256", hs.vault_path(F.col("sha256")).alias("vault_relpath"), "size_bytes")


# chunks


def _spans(target: int, overlap: int) -> str:
    back = max(1, target // 5)
    tail = f"length(regexp_extract(substr(text, s + {target - back} + 1, {back}), '[^\\s]*\\z'))"
    end = f"CASE WHEN s + {target} >= n THEN n ELSE s + {target} - CASE WHEN {tail} = {back} THEN 0 ELSE {tail} END END"
    return f"""WITH RECURSIVE sp AS (
        SELECT doc_id, text, n, s, ({end})::BIGINT AS e FROM (SELECT doc_id, text, length(text)::BIGINT AS n, 0::BIGINT AS s FROM documents WHERE length(text) > 0) a
        UNION ALL
        SELECT doc_id, text, n, s, ({end})::BIGINT AS e FROM (SELECT doc_id, text, n, greatest(e - {overlap}, s + 1) AS s FROM sp WHERE e < n) b)"""


@query(_spans(2000, 200) + " SELECT doc_id, s AS char_start, e AS char_end FROM sp")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunking.spans(tb.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return t.select("doc_id", F.col("char_start").cast("bigint"), F.col("char_end").cast("bigint"))


_PIECES = """, p AS (SELECT doc_id, sha256(text) AS source_sha256, s, e, substr(text, s + 1, e - s) AS piece, strlen(substr(text, 1, s)) AS b FROM sp),
    q AS (SELECT *, sha256(piece) AS text_sha256 FROM p WHERE NOT regexp_full_match(piece, '\\s*'))"""


@query(_spans(400, 50) + _PIECES + """ SELECT doc_id, s AS char_start, e AS char_end, b::BIGINT AS utf8_byte_start, (b + strlen(piece))::BIGINT AS utf8_byte_end, text_sha256 FROM q""")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tb.pieces(spark, sf_dir, 400, 50)
    return t.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("char_start", "char_end", "utf8_byte_start", "utf8_byte_end")), "text_sha256")


def _chunk_id(target: int, overlap: int) -> str:
    config = hs.chunk_config_sha(target, overlap)
    return (
        "sha256('{\"channel\":\"native-text\",\"char_end\":' || e::VARCHAR || ',\"char_start\":' || s::VARCHAR || ',\"chunk_config_sha256\":\"" + config
        + "\",\"extraction_sha256\":\"' || source_sha256 || '\",\"page_number\":null,\"schema_version\":\"1.0.0\",\"source_sha256\":\"' || source_sha256 || '\",\"text_sha256\":\"' || text_sha256 || '\"}')"
    )


@query(_spans(2000, 200) + _PIECES + f" SELECT doc_id, s AS char_start, {_chunk_id(2000, 200)} AS chunk_id FROM q")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.pieces(spark, sf_dir).select("doc_id", F.col("char_start").cast("bigint").alias("char_start"), "chunk_id")


@query(_spans(2000, 200) + _PIECES + """ SELECT d.source, count(DISTINCT d.doc_id)::BIGINT AS documents, count(q.doc_id)::BIGINT AS chunks,
        coalesce(sum(length(q.piece)), 0)::BIGINT AS chars FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id GROUP BY d.source""")
def chunks_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunking.counted(tb.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return t.groupBy("source").agg(
        F.count_distinct("doc_id").alias("documents"), F.sum("chunk_count").alias("chunks"), F.sum("chunk_chars").alias("chars"))


@query(_spans(2000, 200) + _PIECES + f""", c AS (SELECT doc_id, s, {_chunk_id(2000, 200)} AS chunk_id FROM q)
    SELECT chunk_id, CASE WHEN doc_id % 17 = 0 THEN 'text' WHEN doc_id % 19 = 0 THEN 'text_hash' WHEN doc_id % 23 = 0 THEN 'chunk_id' ELSE 'no_page' END AS error
    FROM (SELECT *, CASE WHEN doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 23 = 0 THEN sha256(chunk_id) ELSE chunk_id END AS id2 FROM c) x
    WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 29 = 0""".replace("SELECT chunk_id, CASE", "SELECT id2 AS chunk_id, CASE"))
def chunk_rederive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with damage of four kinds, found again by re-derivation from the pages."""
    t = tb.pieces(spark, sf_dir)
    d = F.col("doc_id")
    kind = F.when(d % 17 == 0, "text").when(d % 19 == 0, "text_hash").when(d % 23 == 0, "chunk_id").when(d % 29 == 0, "no_page")
    t = t.withColumn("k", F.coalesce(kind, F.lit("")))
    chunks = t.select(
        F.when(F.col("k") == "chunk_id", F.sha2("chunk_id", 256)).otherwise(F.col("chunk_id")).alias("chunk_id"), "source_sha256", F.lit("native-text").alias("channel"),
        F.when(F.col("k") == "no_page", 9).cast("int").alias("page_number"), "char_start", "char_end", F.when(F.col("k") == "text", F.concat(F.lit("#"), "piece")).otherwise(F.col("piece")).alias("text"),
        F.when(F.col("k") == "text_hash", F.lit("0" * 64)).otherwise(F.col("text_sha256")).alias("text_sha256"), F.lit(hs.chunk_config_sha(2000, 200)).alias("chunk_config_sha256"))
    page = F.array(F.struct(F.lit(None).cast("int").alias("page_number"), F.col("text").alias("text")))
    bundles = tb.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("source_sha256"), "text").distinct().select("source_sha256", F.col("source_sha256").alias("extraction_sha256"), page.alias("pages"))
    return validate.rederived(chunks, bundles).where("error IS NOT NULL").select("chunk_id", "error")


@query(_spans(2000, 200) + _PIECES + f""", c AS (SELECT q.doc_id, d.lang, {_chunk_id(2000, 200)} AS chunk_id FROM q JOIN documents d ON d.doc_id = q.doc_id)
    SELECT DISTINCT chunk_id FROM c WHERE lang <> 'en' AND chunk_id NOT IN (SELECT chunk_id FROM c WHERE lang = 'en')""")
def append_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tb.pieces(spark, sf_dir, carry=("lang",)).select("lang", "chunk_id")
    return reconcile.only_new(t.where("lang <> 'en'"), t.where("lang = 'en'"), "chunk_id").select("chunk_id")


# reports


@query(_spans(2000, 200) + _PIECES + f""", n AS (SELECT source_sha256, count(*) AS n FROM (SELECT DISTINCT source_sha256, s, e FROM q) u GROUP BY source_sha256),
    r AS (SELECT sha256(text) AS sha256, strlen(text) AS size_bytes, count(*) AS k, min('=' || {_path()}) AS f, max(CASE WHEN l.doc_id IS NULL THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END) AS st
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2)
    SELECT r.sha256, 'txt' AS media_type, size_bytes::BIGINT AS size_bytes, k::BIGINT AS occurrence_count, '''' || f AS first_relpath,
           'evidence/sha256/' || substr(r.sha256, 1, 2) || '/' || r.sha256 AS vault_relpath, CASE st WHEN 0 THEN 'n/a' WHEN 1 THEN 'failed' ELSE 'succeeded' END AS ocr_status,
           coalesce(n.n, 0)::BIGINT AS chunk_count FROM r LEFT JOIN n ON n.source_sha256 = r.sha256""".replace("min('=' || " + _path(), "min('=' || " + _path("d.")))
def index_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = intake_rows(spark, sf_dir).withColumn("relpath", F.concat(F.lit("="), "relpath"))
    d = tb.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "text")
    # equal texts have equal chunks
    chunks = chunking.counted(d).groupBy("sha256").agg(F.max("chunk_count").alias("chunk_count"))
    status = d.join(tb.read(spark, sf_dir, "labels"), "doc_id").groupBy("sha256").agg(F.max("quality").alias("q"))
    return reports.index(intake.records(j, ""), chunks, status.select("sha256", F.when(F.col("q") == 1, "succeeded").otherwise("failed").alias("status")))


_KINDS = ["png", "pdf", "html", "eml", "txt", "bin", "docx"]


def _named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files under seven extensions, some with a telling first line, some empty or too large."""
    d = tb.read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    head = F.when(F.col("doc_id") % 5 == 0, "%PDF-1.7 ").when(F.col("doc_id") % 5 == 1, "Subject: ").otherwise("")
    tail = F.when(F.col("doc_id") % 4 == 0, "%%EOF\n").otherwise("")
    text = F.when(F.col("doc_id") % 31 == 0, "").otherwise(F.concat(head, F.lower("text"), tail))
    return d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("relpath"), text.cast("binary").alias("content"), F.octet_length(text).cast("bigint").alias("size_bytes"))


_NAMED = """WITH f AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' WHEN 3 THEN 'eml' WHEN 4 THEN 'txt' WHEN 5 THEN 'bin' ELSE 'docx' END AS ext,
      CASE WHEN doc_id % 31 = 0 THEN '' ELSE CASE doc_id % 5 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'Subject: ' ELSE '' END || lower(text) || CASE WHEN doc_id % 4 = 0 THEN '%%EOF' || chr(10) ELSE '' END END AS c FROM documents),
    s AS (SELECT *, CASE WHEN starts_with(c, '%PDF') THEN 'pdf' WHEN regexp_matches(split_part(c, chr(10), 1), '^[\\x21-\\x39\\x3b-\\x7e]{1,64}:') THEN 'eml' ELSE 'txt' END AS sniffed FROM f),
    k AS (SELECT *, CASE WHEN c = '' THEN 'RESOURCE_EMPTY' WHEN strlen(c) > 20000 THEN 'RESOURCE_TOO_LARGE'
             WHEN ext = 'png' OR ext = 'docx' OR (ext = 'pdf' AND sniffed <> 'pdf') OR (ext IN ('html', 'eml', 'txt') AND sniffed = 'pdf') THEN 'TAMPER_MAGIC_MISMATCH'
             WHEN sniffed = 'pdf' AND c NOT LIKE '%\\%\\%EOF%' ESCAPE '\\' THEN 'TAMPER_TRUNCATED' END AS reason,
             CASE WHEN ext = 'bin' THEN sniffed ELSE ext END AS media FROM s)"""


def _judged_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schemas import RunConfig

    # the SQL has texts, which no head cuts within a character
    return intake.judged(_named_rows(spark, sf_dir), RunConfig(max_file_bytes=20000), whole_characters=True)


@query(_NAMED + " SELECT media AS media_type, count(*)::BIGINT AS n FROM k WHERE reason IS NULL GROUP BY media")
def media_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.census(_judged_named(spark, sf_dir).where("reason_code IS NULL"), "media_type")


@query(_NAMED + " SELECT reason AS reason_code, count(*)::BIGINT AS n FROM k WHERE reason IS NOT NULL GROUP BY reason")
def drop_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.census(_judged_named(spark, sf_dir).where("reason_code IS NOT NULL"), "reason_code")


@query(_NAMED + " SELECT 'f' || doc_id::VARCHAR || '.' || ext AS relpath, media AS media_type, sniffed AS magic_label, sha256(c) AS sha256 FROM k WHERE reason IS NULL")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_named(spark, sf_dir).where("reason_code IS NULL").select("relpath", "media_type", "magic_label", "sha256")


_WARN = """WITH w AS (SELECT source AS media_type, CASE WHEN length(text) > 5000 THEN 'long text: ' || length(text)::VARCHAR WHEN text LIKE '%@%' THEN 'address: ' || doc_id::VARCHAR ELSE 'plain' END AS w FROM documents)"""


def _warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents")
    w = F.when(F.length("text") > 5000, F.concat(F.lit("long text: "), F.length("text").cast("string"))).when(
        F.col("text").contains("@"), F.concat(F.lit("address: "), F.col("doc_id").cast("string"))).otherwise("plain")
    return d.select(F.col("source").alias("media_type"), F.array(w).alias("parse_warnings"))


@query(_WARN + " SELECT media_type, trim(split_part(w, ':', 1)) AS warning_class, count(*)::BIGINT AS n FROM w GROUP BY 1, 2")
def warning_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.warning_census(_warned(spark, sf_dir))


_PRINT = "substr(sha256('{\"key\":\"' || key || '\",\"kind\":\"' || kind || '\"}'), 1, 16)"


@query(_NAMED + ", w AS (" + _WARN.split("(", 1)[1] + f""", d AS (SELECT 'drop' AS kind, reason AS key, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'parse_warning', media_type || '|' || trim(split_part(w, ':', 1)), count(*) FROM w GROUP BY 2)
    SELECT kind, n::BIGINT AS n, {_PRINT} AS fingerprint FROM d""")
def issue_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reports.issues(_judged_named(spark, sf_dir).where("reason_code IS NOT NULL"), _warned(spark, sf_dir))
    return t.select("kind", F.col("count").alias("n"), "fingerprint")


@query("""SELECT count(DISTINCT sha256(text))::BIGINT AS unique_evidence_objects, count(*)::BIGINT AS total_occurrences, (SELECT count(*) FROM labels WHERE toxic = 1)::BIGINT AS dropped,
          (SELECT count(*) FROM conversations)::BIGINT AS rag_chunks FROM documents""")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(intake.records(intake_rows(spark, sf_dir), ""), tb.read(spark, sf_dir, "labels").where("toxic = 1"), tb.read(spark, sf_dir, "conversations"))


# reconciliation


@query("""SELECT coalesce(d.doc_id, l.k) AS doc_id, CASE WHEN l.k IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unlisted' WHEN d.a = l.b THEN 'match' ELSE 'mismatch' END AS status
          FROM (SELECT doc_id, n_chars % 2 AS a FROM documents) d FULL JOIN (SELECT doc_id + 5 AS k, quality::BIGINT AS b FROM labels) l ON d.doc_id = l.k""")
def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).alias("v"))
    lb = tb.read(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("doc_id"), F.col("quality").cast("bigint").alias("v"))
    return reconcile.compare(d, lb, "doc_id", "v").select("doc_id", "status")


@query("""WITH x AS (SELECT doc_id, max(s = 'w') AS w, max(s = 'a') AS a, max(s = 'd') AS d FROM (SELECT doc_id, 'w' AS s FROM documents UNION ALL SELECT doc_id, 'a' FROM labels WHERE quality = 1
          UNION ALL SELECT doc_id + 3, 'd' FROM labels WHERE toxic = 1) u GROUP BY doc_id)
          SELECT doc_id, CASE WHEN a AND d THEN 'accepted and dropped' WHEN NOT w THEN 'not walked' ELSE 'unaccounted' END AS failure FROM x WHERE (a AND d) OR NOT w OR (NOT a AND NOT d)""")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = tb.read(spark, sf_dir, "labels")
    return reconcile.reconcile(tb.read(spark, sf_dir, "documents"), lb.where("quality = 1"), lb.where("toxic = 1").select((F.col("doc_id") + 3).alias("doc_id")), "doc_id")


@query("""WITH a AS (SELECT DISTINCT lang, source FROM documents WHERE n_chars > 3000), b AS (SELECT DISTINCT lang, source FROM documents WHERE n_chars < 60)
          SELECT 'except' AS op, lang, source FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT 'intersect', lang, source FROM (SELECT * FROM a INTERSECT SELECT * FROM b) y
          UNION ALL SELECT 'union', lang, source FROM (SELECT * FROM a UNION SELECT * FROM b) z
          UNION ALL SELECT 'left', lang, source FROM (SELECT * FROM a EXCEPT SELECT * FROM b) v UNION ALL SELECT 'right', lang, source FROM (SELECT * FROM b EXCEPT SELECT * FROM a) w""")
def set_ops_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents")
    a, b = d.where("n_chars > 3000").select("lang", "source"), d.where("n_chars < 60").select("lang", "source")
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "lang", "source")
    sides = reconcile.same_set(a, b).select(F.col("side").alias("op"), "lang", "source")
    return tag(a.subtract(b), "except").union(tag(a.intersect(b), "intersect")).union(tag(a.union(b).distinct(), "union")).union(sides)


@query("""SELECT coalesce(a.h, b.h) AS h, coalesce(a.n, 0)::BIGINT AS left_count, coalesce(b.n, 0)::BIGINT AS right_count FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) a
          FULL JOIN (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY 1) b ON a.h = b.h WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "lang")
    return reconcile.same_multiset(d, d.where("lang <> 'fr'"), "h")


@query("""WITH b AS (SELECT DISTINCT source || ':' || (doc_id % 50)::VARCHAR AS k, sha256(lang) AS d FROM documents), p AS (SELECT k, min(d) AS d, count(*) AS n FROM b GROUP BY k)
          SELECT b.k, CASE WHEN p.k IS NULL THEN 'insert' WHEN b.d = p.d THEN 'same' ELSE 'conflict' END AS action FROM b LEFT JOIN (SELECT * FROM p WHERE n > 1) p ON b.k = p.k""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tb.read(spark, sf_dir, "documents").select(F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string")).alias("k"), F.sha2("lang", 256).alias("d")).distinct()
    old = b.groupBy("k").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return reconcile.upsert_plan(b, old, "k", "d")


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no, count(*) OVER () AS c FROM documents)
          SELECT doc_id, line_no::BIGINT AS line_no FROM n WHERE line_no % greatest(1, c // 300) = 0""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.systematic_sample(tb.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", size=300)


# hashes

_LEVELS = "WITH l0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, unhex(sha256(unhex('00') || unhex(h))) AS h FROM (SELECT sha256(n_name) AS h FROM nation) x)" + "".join(
    f", l{k} AS (SELECT i // 2 AS i, unhex(sha256(unhex('01') || arg_min(h, i) || arg_max(h, i))) AS h FROM l{k - 1} GROUP BY i // 2)" for k in range(1, 6))


@query(_LEVELS + " SELECT lower(hex(h)) AS root, 25::BIGINT AS leaves FROM l5")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_root(tb.read(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("h")), "h")


_CHAIN = """WITH RECURSIVE n AS (SELECT n_regionkey AS log, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation),
    c AS (SELECT n.log, n.k, '{"nation":"' || n_name || '"}' AS details, repeat('0', 64) AS prev,
            sha256('{"details":{"nation":"' || n_name || '"},"event":"nation","prev_sha256":"' || repeat('0', 64) || '","sequence":' || n.k::VARCHAR || ',"utc":"2024-01-01"}') AS h FROM n WHERE k = 0
          UNION ALL SELECT n.log, n.k, '{"nation":"' || n.n_name || '"}', c.h,
            sha256('{"details":{"nation":"' || n.n_name || '"},"event":"nation","prev_sha256":"' || c.h || '","sequence":' || n.k::VARCHAR || ',"utc":"2024-01-01"}') FROM c JOIN n ON n.log = c.log AND n.k = c.k + 1),
    t AS (SELECT log, k, prev, h, CASE WHEN log = 3 AND k = 3 THEN 7 ELSE k END AS seq, CASE WHEN log = 1 AND k = 2 THEN '{"nation":"NOWHERE"}' ELSE details END AS details FROM c WHERE NOT (log = 2 AND k = 1)),
    e AS (SELECT *, CASE WHEN sha256('{"details":' || details || ',"event":"nation","prev_sha256":"' || prev || '","sequence":' || seq::VARCHAR || ',"utc":"2024-01-01"}') <> h THEN 'hash'
            WHEN prev <> coalesce(lag(h) OVER (PARTITION BY log ORDER BY k), repeat('0', 64)) THEN 'link' WHEN seq <> row_number() OVER (PARTITION BY log ORDER BY k) - 1 THEN 'sequence' END AS error FROM t)
    SELECT log, count(*)::BIGINT AS events, count(error) = 0 AS valid, min(CASE WHEN error IS NOT NULL THEN k END)::INT AS first_line, arg_min(error, CASE WHEN error IS NOT NULL THEN k END) AS first_error FROM e GROUP BY log"""


@query(_CHAIN)
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody.verify(tb.chains(spark, sf_dir), "log")


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars::VARCHAR || ',"none":null,"source":"' || source || '"}') AS h FROM documents""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(hs.canonical_json(lang=F.col("lang"), n=(F.col("n_chars"), "raw"), source=F.col("source"), none=F.lit(None).cast("string")), 256).alias("h"))


# usage

_MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tb.MODELS.items()) + " END"
_TIER = "CASE WHEN coalesce(model, '') = '' THEN 'UNKNOWN' " + " ".join(f"WHEN regexp_matches(lower(model), '{p}') THEN '{t}'" for t, p in usage.Targets().tiers) + " ELSE 'UNKNOWN' END"
_USAGE = f"""u AS (SELECT {_MODEL} AS model, CASE WHEN user_id % 3 = 0 AND (user_id % 2 = 0 OR user_id % 9 = 0) THEN 'main' ELSE 'subagent' END AS role, ts,
      floor(value * 100)::BIGINT AS i, CASE WHEN event_id % 7 > 0 THEN floor(value * 60)::BIGINT ELSE 0 END AS cr, CASE WHEN event_id % 5 > 0 THEN floor(value * 50)::BIGINT ELSE 0 END AS cw,
      floor(value * 10)::BIGINT AS o, floor(value * 1000)::BIGINT AS a FROM events),
    r AS (SELECT model, role, count(*)::BIGINT AS calls, sum(i)::BIGINT AS in_tok, sum(cr)::BIGINT AS cr_tok, sum(cw)::BIGINT AS cw_tok, sum(o)::BIGINT AS out_tok, sum(a)::BIGINT AS aiu FROM u
      WHERE strftime(ts, '%Y-%m-%d') >= '{FIRST_DATE}' GROUP BY model, role)"""


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rollup(tb.usage(spark, sf_dir), FIRST_DATE)


@query(f"WITH {_USAGE} SELECT * FROM r")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir)


@query(f"WITH {_USAGE} SELECT model, {_TIER} AS tier, count(*)::BIGINT AS n FROM u GROUP BY model")
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.usage(spark, sf_dir).groupBy("model", usage.tier(F.col("model")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_COST = f"""k AS (SELECT CASE WHEN coalesce(sum(aiu), 0) = 0 THEN 1 ELSE sum(aiu) END AS total, coalesce(sum(CASE WHEN {_TIER} = 'FRONTIER' THEN aiu END), 0) AS f,
      coalesce(sum(CASE WHEN role = 'main' THEN greatest(in_tok - cr_tok - cw_tok, 0) * 1.0::DOUBLE + cw_tok * 1.25::DOUBLE + cr_tok * 0.1::DOUBLE END), 0) AS w,
      CASE WHEN coalesce(sum(CASE WHEN role = 'main' THEN calls END), 0) = 0 THEN 1 ELSE sum(CASE WHEN role = 'main' THEN calls END) END AS c FROM r)"""


@query(f"WITH {_USAGE}, {_COST} SELECT total::BIGINT AS total_nano_aiu, f::DOUBLE / total::DOUBLE AS frontier_cost_share FROM k")
def frontier_cost_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cost_kpis(_rollup(spark, sf_dir)).select("total_nano_aiu", "frontier_cost_share")


@query(f"WITH {_USAGE}, {_COST} SELECT round(w / c, 6) AS avg_main_weighted_input_per_turn FROM k")
def weighted_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cost_kpis(_rollup(spark, sf_dir)).select(F.round("avg_main_weighted_input_per_turn", 6).alias("avg_main_weighted_input_per_turn"))


_TASKS = f"""t AS (SELECT 's' || (user_id % 10)::VARCHAR AS session, CASE WHEN event_id % 11 = 1 THEN '?' WHEN event_id % 11 = 2 THEN NULL WHEN event_id % 11 < 6 THEN 'explore' WHEN event_id % 11 < 9 THEN 'task'
      ELSE 'review' END AS agent_type, {_MODEL} AS model FROM events WHERE event_id % 11 > 0 AND event_id % 13 > 0)"""


@query(f"WITH {_TASKS} SELECT session, agent_type, model, count(*)::BIGINT AS n FROM t GROUP BY ALL")
def dispatch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = usage.dispatches(tb.dispatch_lines(spark, sf_dir))
    return t.groupBy("session", "agent_type", "model").agg(F.count(F.lit(1)).alias("n"))


_SHARES = f"""m AS (SELECT count(*) AS n, sum(CASE WHEN agent_type IN ('explore', 'task') THEN 1 ELSE 0 END) AS mech, sum(CASE WHEN agent_type IN ('explore', 'task') AND (model IS NULL OR {_TIER} = 'ECONOMY') THEN 1 ELSE 0 END) AS e,
      sum(CASE WHEN agent_type IN ('explore', 'task') AND model IS NOT NULL AND {_TIER} IN ('STANDARD', 'FRONTIER') THEN 1 ELSE 0 END) AS x FROM t)"""


@query(f"WITH {_TASKS}, {_SHARES} SELECT n::BIGINT AS task_dispatches, mech::BIGINT AS mechanical_dispatches, e::DOUBLE / mech AS economy_share_of_mechanical_dispatches FROM m")
def economy_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.dispatch_kpis(usage.dispatches(tb.dispatch_lines(spark, sf_dir))).drop("subagent_escalation_rate")


@query(f"WITH {_TASKS}, {_SHARES} SELECT x::DOUBLE / mech AS subagent_escalation_rate FROM m")
def escalation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.dispatch_kpis(usage.dispatches(tb.dispatch_lines(spark, sf_dir))).select("subagent_escalation_rate")


@query(f"""WITH {_USAGE}, {_COST}, {_TASKS}, {_SHARES}, v AS (SELECT 'frontier_cost_share' AS kpi, f::DOUBLE / total::DOUBLE AS value, 0.5::DOUBLE AS bound FROM k
      UNION ALL SELECT 'avg_main_weighted_input_per_turn', round(w / c, 6), 25000 FROM k UNION ALL SELECT 'economy_share_of_mechanical_dispatches', e::DOUBLE / mech, 0.8 FROM m
      UNION ALL SELECT 'subagent_escalation_rate', x::DOUBLE / mech, 0.15 FROM m)
    SELECT kpi, round(value, 6) AS value, bound, CASE WHEN kpi LIKE 'economy%' THEN value < bound ELSE value > bound END AS breached FROM v""")
def kpi_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = usage.kpis(_rollup(spark, sf_dir), usage.dispatches(tb.dispatch_lines(spark, sf_dir)))
    return usage.breaches(row).withColumn("value", F.round("value", 6))


@query(f"WITH {_USAGE} SELECT model, role, aiu FROM r ORDER BY aiu DESC, model NULLS FIRST, role LIMIT 12")
def usage_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_usage(_rollup(spark, sf_dir)).select("model", "role", "aiu")


_DAYS = "d AS (SELECT strftime(ts, '%Y-%m-%d') AS \"at\", sum(floor(value * 1000)::BIGINT)::BIGINT AS cost FROM events GROUP BY 1)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.usage(spark, sf_dir).groupBy(F.substring("created_at", 1, 10).alias("at")).agg(F.sum("total_nano_aiu").alias("cost"))


@query(f"""WITH {_DAYS}, x AS (SELECT "at", cost AS value, cost - lag(cost) OVER (ORDER BY "at") AS change FROM d)
    SELECT *, CASE WHEN change IS NULL THEN '' WHEN change = 0 THEN '(=)' WHEN change > 0 THEN 'up' ELSE 'down' END AS trend FROM x""")
def kpi_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trend(_daily(spark, sf_dir), "cost")


@query(f"WITH {_DAYS} SELECT * FROM d ORDER BY \"at\" DESC LIMIT 10")
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.retained(_daily(spark, sf_dir), 10)


@query("""SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS main_turns, sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END)::BIGINT AS other_turns, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id""")
def role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("main_turns"), F.count_if(F.col("role") != "user").alias("other_turns"), F.count(F.lit(1)).alias("turns"))


# HTML and strings


def _replaced(column: str) -> str:
    for pattern, by in markup.CHAIN:
        made = "''" if not by else " || ".join({"\n": "chr(10)", "\t": "chr(9)"}.get(c, f"'{c}'") for c in by)
        column = f"regexp_replace({column}, '{pattern}', {made}, 'g')"
    return column


@query(f"SELECT page_id, sha256({_replaced('html')}) AS text_sha256, length({_replaced('html')})::BIGINT AS chars FROM pages")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tb.read(spark, sf_dir, "pages").select("page_id", markup.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("bigint").alias("chars"))


@query(f"SELECT page_id, sha256({_replaced('html')}) AS text_sha256 FROM pages")
def html_parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general parser on the same pages, held against the regular-expression chain in SQL."""
    t = tb.read(spark, sf_dir, "pages").select("page_id", markup.parse_html("html").alias("p"))
    return t.select("page_id", F.sha2("p.text", 256).alias("text_sha256"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.read(spark, sf_dir, "pages").select("page_id", markup.title(F.col("html")).alias("title"))


@query(f"""SELECT page_id, len(regexp_extract_all(html, '{markup.CHAIN[0][0]}'))::BIGINT AS skipped, len(regexp_extract_all(regexp_replace(html, '{markup.CHAIN[0][0]}', '', 'g'), '(?s)<!--.*?-->'))::BIGINT AS comments FROM pages""")
def html_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return tb.read(spark, sf_dir, "pages").select("page_id", markup.hidden_blocks(h).cast("bigint").alias("skipped"), markup.comments(h).cast("bigint").alias("comments"))


_CELL = "CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) ELSE '' END || source"


@query(f"SELECT doc_id, CASE WHEN regexp_matches({_CELL}, '^[=+\\-@\\t\\r]') THEN '''' || {_CELL} ELSE {_CELL} END AS cell FROM documents")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "\t", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    return tb.read(spark, sf_dir, "documents").select("doc_id", tx.csv_guard(F.concat(lead, "source")).alias("cell"))


_PATHS = ["a/b.txt", "../b.txt", "/a/b", "a//b", "a/./b", "a/..b/c", "..%2fb"]
_PATH_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATHS)) + " END || '/' || source"


@query(f"SELECT doc_id, len(list_filter(string_split({_PATH_SQL}, '/'), lambda s: s IN ('', '.', '..'))) > 0 AS unsafe FROM documents")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return tb.read(spark, sf_dir, "documents").select("doc_id", tx.path_is_unsafe(F.concat_ws("/", p, "source")).alias("unsafe"))


_LINE = "CASE doc_id % 4 WHEN 0 THEN 'Subject: x' WHEN 1 THEN 'http://' || source WHEN 2 THEN 'two words: x' ELSE 'none' END"


@query(f"SELECT doc_id, regexp_matches({_LINE}, '^[\\x21-\\x39\\x3b-\\x7e]{{1,64}}:') AS header_like FROM documents")
def header_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    line = F.when(k == 0, "Subject: x").when(k == 1, F.concat(F.lit("http://"), "source")).when(k == 2, "two words: x").otherwise("none")
    return tb.read(spark, sf_dir, "documents").select("doc_id", content.looks_like_header(line).alias("header_like"))


# decisions


@query("""WITH s AS (SELECT doc_id // 9 AS run, 85 + (doc_id * 7) % 16 AS score FROM labels), g AS (SELECT run, count(score)::BIGINT AS scores, min(score)::BIGINT AS lowest FROM s GROUP BY run)
          SELECT *, scores = 3 AND lowest >= 90 AS passed FROM g""")
def unanimity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tb.read(spark, sf_dir, "labels").select(F.expr("doc_id div 9").alias("run"), (F.lit(85) + (F.col("doc_id") * 7) % 16).alias("score"))
    return decisions.unanimity(s, "run")


_PIN = "CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 2 ELSE 3 END"


@query(f"""WITH p AS (SELECT doc_id, {_PIN} AS t, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN -1 ELSE 0 END AS d FROM labels), q AS (SELECT doc_id, t, least(greatest(t + d, 1), 2) AS n FROM p)
    SELECT doc_id, CASE n WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'STANDARD' ELSE 'FRONTIER' END AS pin, CASE t WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'FRONTIER' END AS next_tier FROM q""")
def pin_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = tb.read(spark, sf_dir, "labels")
    t = F.element_at(F.array(*map(F.lit, decisions.TIERS)), (F.col("doc_id") % 3 + 1).cast("int"))
    d = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, -1).otherwise(0)
    return lb.select("doc_id", decisions.pin_step(t, d, F.lit("ECONOMY"), F.lit("STANDARD")).alias("pin"), decisions.escalate(t).alias("next_tier"))


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS cycle, sum(value) > 16000 AS changed, count(*) > 340 AS breached FROM events GROUP BY 1),
    w AS (SELECT *, coalesce(sum(changed::INT) OVER (ORDER BY cycle ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 0 AS may_act,
      count(*) OVER (ORDER BY cycle ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AND sum(breached::INT) OVER (ORDER BY cycle ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 0 AS clean FROM c) SELECT * FROM w""")
def tuning_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.read(spark, sf_dir, "events")
    c = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("cycle")).agg((F.sum("value") > 16000).alias("changed"), (F.count(F.lit(1)) > 340).alias("breached"))
    return decisions.cooled(c)


@query("SELECT bool_and(quality = 1 OR toxic = 0) AS passed FROM labels")
def all_of_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.all_pass(tb.read(spark, sf_dir, "labels").select(((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("passed")))


# more of the decision tables, checks and reports

_WORK = "run_and_report search summarize mechanical_edit docs debugging security tidy".split()


@query("""WITH w AS (SELECT doc_id, doc_id % 8 AS k, coalesce(n_chars, 0) > 2000 AS heavy, doc_id % 3 = 0 AS ver, doc_id % 17 = 0 AS irr, doc_id % 19 = 0 AS stakes FROM documents)
    SELECT doc_id, CASE WHEN irr OR stakes THEN 'FRONTIER' WHEN k = 2 AND heavy THEN 'STANDARD' WHEN k < 3 THEN 'ECONOMY' WHEN k < 5 THEN 'STANDARD' WHEN k < 7 THEN 'FRONTIER' WHEN ver THEN 'STANDARD' ELSE 'FRONTIER' END AS tier FROM w""")
def route_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    kind = F.element_at(F.array(*map(F.lit, _WORK)), (F.col("doc_id") % 8 + 1).cast("int"))
    heavy = F.coalesce("n_chars", F.lit(0)) > 2000
    return d.select("doc_id", decisions.route(kind, heavy, F.col("doc_id") % 3 == 0, F.col("doc_id") % 17 == 0, F.col("doc_id") % 19 == 0).alias("tier"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 80 + doc_id % 25 END AS score, CASE doc_id % 3 WHEN 0 THEN ' None ' WHEN 1 THEN 'crash' END AS blocker, doc_id % 2 AS changes FROM labels)
    SELECT doc_id, coalesce(score BETWEEN 0 AND 100 AND CASE WHEN score >= 90 THEN lower(trim(blocker)) = 'none' ELSE changes >= 1 END, FALSE) AS valid FROM s""")
def score_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    score = F.when(k % 29 != 0, F.lit(80) + k % 25)
    blocker = F.when(k % 3 == 0, " None ").when(k % 3 == 1, "crash")
    return tb.read(spark, sf_dir, "labels").select("doc_id", decisions.score_is_valid(score, blocker, k % 2).alias("valid"))


@query("""WITH r AS (SELECT user_id AS run, event_id % 4 + 1 AS check_no, 1 + user_id % 4 AS seats, value > 120 AS passed FROM events),
    g AS (SELECT run, min(seats)::BIGINT AS seats, min(CASE WHEN passed THEN check_no END) AS first FROM r GROUP BY run)
    SELECT run, seats, CASE WHEN seats < 2 THEN 'abort' WHEN seats = 2 THEN 'degraded' WHEN first = 1 THEN 'converged_1' WHEN first = 2 THEN 'converged_2' ELSE 'not_converged' END AS status FROM g""")
def convergence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tb.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), (F.col("event_id") % 4 + 1).alias("check_no"), (1 + F.col("user_id") % 4).alias("seats"), (F.col("value") > 120).alias("passed"))
    return decisions.convergence(r, "run")


@query(f"""WITH b AS ({ORACLES["kpi_breaches"]}), l(kpi, meaning, lever) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in decisions.LEVERS)})
    SELECT b.*, meaning, lever FROM b LEFT JOIN l USING (kpi) WHERE breached""")
def breach_levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.diagnose(kpi_breaches(spark, sf_dir))


@query("""SELECT h.source AS reason_code, h.fingerprint FROM (SELECT source, sha256(source) AS fingerprint FROM documents GROUP BY source) h
          WHERE h.fingerprint NOT IN (SELECT sha256(source) FROM documents WHERE doc_id % 97 = 0 AND source IS NOT NULL)""")
def new_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents").select("doc_id", "source").where("source IS NOT NULL").withColumn("fingerprint", F.sha2("source", 256))
    harvest = d.groupBy(F.col("source").alias("reason_code"), "fingerprint").agg(F.count(F.lit(1)).alias("n")).drop("n")
    return reports.new_issues(harvest, d.where("doc_id % 97 = 0"))


@query("""SELECT 'orphan_chunk' AS "check", sha256('c' || doc_id::VARCHAR) AS subject, sha256(text) AS detail FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 <> 0)""")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    chunks = d.select(F.sha2(F.concat(F.lit("c"), F.col("doc_id").cast("string")), 256).alias("chunk_id"), F.col("sha256").alias("source_sha256"))
    return validate.orphans(chunks, d.where("doc_id % 10 <> 0").select("sha256").distinct())


_SPOILT = "CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END"


@query(f"""SELECT 'vault_hash' AS "check", sha256(text) AS subject, sha256({_SPOILT}) AS detail FROM documents WHERE sha256(text) <> sha256({_SPOILT})""")
def vault_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return validate.vault(tb.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), spoilt.cast("binary").alias("content")))


@query(f"""SELECT 'vault_hash' AS "check", sha256(text) AS subject, sha256({_SPOILT}) AS detail FROM documents WHERE sha256(text) <> sha256({_SPOILT}) ORDER BY subject, detail LIMIT 50""")
def failure_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.preview(vault_hashes(spark, sf_dir))


@query("""SELECT conv_id, turn, conv_id % 7 <> 0 AND conv_id % 11 <> 0 AND turn % 5 <> 4 AS valid, CASE WHEN conv_id % 7 = 0 THEN 'smuggled' ELSE '' END AS unknown FROM conversations""")
def closed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as JSON lines: some with a name outside the schema, some with an ill-typed number, some cut off."""
    c = tb.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    extra = F.when(F.col("conv_id") % 7 == 0, ',"smuggled":1').otherwise("")
    number = F.when(F.col("conv_id") % 11 == 0, '"two"').otherwise("2")
    tail = F.when((F.col("turn") % 5 == 4) & (F.col("conv_id") % 7 != 0), "").otherwise("}")
    line = F.concat(F.lit('{"role":"'), "role", F.lit('","n":'), number, extra, tail)
    t = schema_violations(c.withColumn("value", line), "role string, n int")
    # of a line that is cut off no names can be read; one with a smuggled name is whole here, and invalid all the same
    return t.select("conv_id", "turn", "valid", F.array_join("unknown", "|").alias("unknown"))


@query("""WITH a AS (SELECT sha256(text) AS k, count(*)::BIGINT AS n FROM documents GROUP BY 1), b AS (SELECT sha256(text) AS k, count(*)::BIGINT AS n FROM documents WHERE doc_id % 40 <> 0 GROUP BY 1)
    SELECT 'id_parity' AS "check", a.k AS subject, a.n::VARCHAR || ' / ' || coalesce(b.n, 0)::VARCHAR AS detail FROM a LEFT JOIN b USING (k) WHERE a.n <> coalesce(b.n, 0)""")
def id_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("chunk_id"))
    return validate.id_parity(d, d.where("doc_id % 40 <> 0"))


@query("""WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' ELSE 'tiff' END AS kind, doc_id % 3 AS r FROM documents)
    SELECT CASE WHEN kind = 'txt' THEN 'n/a' WHEN r = 0 THEN 'succeeded' WHEN r = 1 THEN 'ocr_unavailable' ELSE 'n/a' END AS status, count(*)::BIGINT AS n FROM b GROUP BY 1""")
def ocr_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read(spark, sf_dir, "documents").select("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("png", "pdf", "txt", "tiff"))), (F.col("doc_id") % 4 + 1).cast("int"))
    none = F.array().cast("array<string>")
    bundles = d.select(
        F.col("doc_id").cast("string").alias("source_sha256"), kind.alias("media_type"), F.when(F.col("doc_id") % 3 == 0, "raw").alias("ocr_raw_sha256"),
        F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("ocr_unavailable"))).otherwise(none).alias("parse_warnings"))
    return reports.census(reports.ocr_status(bundles), "status")


@query()
def corpus_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle roots over all chunk ids, document hashes and manifest lines; levels in SQL would be too slow, a plain version is in the tests."""
    chunks = tb.pieces(spark, sf_dir).select("chunk_id")
    docs = tb.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")).distinct()
    return merkle.corpus_roots(chunks, docs, docs.select("sha256", hs.vault_path(F.col("sha256")).alias("relpath")))


@query("""WITH c AS (SELECT event_type AS lever, dense_rank() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%d'))::BIGINT AS cycle, user_id, value FROM events),
    v AS (SELECT lever, cycle, count(*)::BIGINT AS before, count(CASE WHEN user_id % 2 = 0 THEN 1 END)::BIGINT * 2 AS after, lever < 'm' AS higher, max(user_id) % 9 = 0 AS q FROM c GROUP BY lever, cycle),
    b AS (SELECT *, CASE WHEN higher THEN after < before ELSE before < after END OR q AS bad FROM v),
    r AS (SELECT lever, cycle, CASE WHEN bad THEN 'REVERTED' ELSE 'VERIFIED' END AS verdict, CASE WHEN bad THEN cycle + 4 END AS retry_from FROM b)
    SELECT *, coalesce(cycle < max(retry_from) OVER (PARTITION BY lever ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS repeated_too_soon FROM r""")
def verify_and_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.read(spark, sf_dir, "events").select(F.col("event_type").alias("lever"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    # a day's figures first: the ranking then runs over a row for each lever and day
    day = e.groupBy("lever", "day").agg(F.count(F.lit(1)).alias("before"), (F.count_if(F.col("user_id") % 2 == 0) * 2).alias("after"), (F.max("user_id") % 9 == 0).alias("quality_breach"))
    cycle = F.row_number().over(Window.partitionBy("lever").orderBy("day")).cast("bigint")
    changes = day.withColumn("cycle", cycle).withColumn("higher_is_better", F.col("lever") < "m")
    return decisions.reviewed(changes, "lever").select("lever", "cycle", "verdict", "retry_from", "repeated_too_soon")
