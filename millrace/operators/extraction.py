"""Bundles: text pages and metadata of each accepted content, by media type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import markup, parsers
from ..functions import text as tx
from ..schemas import BUNDLES, ENGINE_VERSION, OCR_MEDIA, struct



def _bundle(df: DataFrame, **given) -> DataFrame:
    """df as a bundle: given columns, typed nulls and empty arrays for the rest."""
    given = {"tool_version": F.lit(ENGINE_VERSION)} | given
    out = []
    for f in struct(BUNDLES).fields:
        kind = f.dataType.simpleString()
        c = given.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None))
        if kind.startswith("array"):
            c = F.coalesce(c.cast(kind), F.array().cast(kind))
        out.append(c.cast(kind).alias(f.name))
    return df.select(*out)


def _page(text) -> object:
    return F.array(F.struct(F.lit(None).cast("int").alias("page_number"), text.alias("text")))


def extract(records: DataFrame, objects: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Bundles of records (sha256, media_type) with objects (sha256, content).

    Text is decoded in the JVM; HTML, mail, CSV shape and Office files go
    through vectorised parsers, each over its own media type only.  Images and
    PDF take stored recognition results (ocr: source_sha256, channel, pages,
    ocr_raw_sha256) or are marked as without; legacy Office files need conversion.
    """
    t = records.select(F.col("sha256").alias("source_sha256"), "media_type").join(objects.select(F.col("sha256").alias("source_sha256"), "content"), "source_sha256")
    text = tx.decoded(F.col("content"))
    lossy = F.when(~F.is_valid_utf8(F.col("content").cast("string")), F.array(F.lit(parsers.LOSSY))).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("body", F.when(F.col("media_type").isin("txt", "csv", "html"), text)).withColumn("lossy", lossy)
    native = {"channel": F.lit("native-text")}

    def only(*media: str) -> DataFrame:
        return t.where(F.col("media_type").isin(*media))

    plain = _bundle(only("txt"), **native, pages=_page(F.col("body")), parse_warnings=F.col("lossy"))
    shape = only("csv").withColumn("s", parsers.csv_shape("body"))
    meta = F.array(F.struct(F.lit("csv").alias("name"), F.lit(1).alias("page_number"), F.col("s.rows").alias("rows"), F.col("s.cols").alias("cols")))
    table = _bundle(shape, **native, pages=_page(F.col("body")), tables_meta=meta, parse_warnings=F.concat("lossy", "s.warnings"))
    web = only("html").withColumn("h", markup.parse_html("body"))
    web = _bundle(web, **native, pages=_page(F.col("h.text")), subject=F.col("h.title"), parse_warnings=F.concat("lossy", "h.warnings"))
    mail = only("eml").withColumn("m", parsers.parse_mail("content"))
    fields = {c: F.col(f"m.{c}") for c in ("subject", "date_raw", "message_id", "recipients", "raw_headers")}
    mail = _bundle(mail, **native, **fields, pages=_page(F.col("m.text")), parse_warnings=F.col("m.warnings"))
    office = only("docx", "xlsx").withColumn("o", parsers.parse_office("media_type", "content"))
    channel = F.when(F.size("o.pages") > 0, "native-text").otherwise("none")
    office = _bundle(office, channel=channel, pages=F.col("o.pages"), tables_meta=F.col("o.tables"), parse_warnings=F.col("o.warnings"))
    rest = only("doc", "xls", "other")
    note = F.when(F.col("media_type") == "other", F.array().cast("array<string>")).otherwise(F.array(F.lit("needs_conversion")))
    rest = _bundle(rest, channel=F.lit("none"), parse_warnings=note)
    scans = only(*OCR_MEDIA)
    if ocr is None:
        scans = _bundle(scans, channel=F.lit("none"), parse_warnings=F.array(F.lit("ocr_unavailable")))
    else:
        got = scans.join(ocr.select("source_sha256", F.col("channel").alias("c"), F.col("pages").alias("p"), F.col("ocr_raw_sha256").alias("r")), "source_sha256", "left")
        why = F.when(F.col("r").isNull(), F.array(F.lit("ocr_unavailable"))).when(F.col("p").isNull(), F.array(F.lit("ocr_result_unparseable"))).otherwise(F.array().cast("array<string>"))
        scans = _bundle(got, channel=F.when(F.col("p").isNull(), "none").otherwise(F.col("c")), pages=F.col("p"), ocr_raw_sha256=F.col("r"), parse_warnings=why)
    out = plain
    for part in (table, web, mail, office, rest, scans):
        out = out.unionByName(part)
    return out


def extraction_sha(bundles: DataFrame) -> DataFrame:
    """bundles with extraction_sha256: the hash of what a bundle holds, in canonical JSON."""
    page = lambda p: hs.canonical_json(page_number=(p["page_number"], "raw"), text=p["text"])
    pages = F.concat(F.lit("["), F.concat_ws(",", F.transform("pages", page)), F.lit("]"))
    listed = lambda c: F.concat(F.lit("["), F.concat_ws(",", F.transform(c, hs.json_string)), F.lit("]"))
    held = hs.canonical_json(
        source_sha256=F.col("source_sha256"), media_type=F.col("media_type"), channel=F.col("channel"), pages=(pages, "raw"), parse_warnings=(listed("parse_warnings"), "raw"),
        subject=F.col("subject"), date_raw=F.col("date_raw"), message_id=F.col("message_id"), ocr_raw_sha256=F.col("ocr_raw_sha256"),
    )
    return bundles.withColumn("extraction_sha256", F.sha2(held, 256))
