"""File type from leading bytes, tamper checks and classification, all in the JVM.

Bytes are looked at as Latin-1 text, where each is one character, so prefixes
and tails are regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

HEAD = TAIL = 8192
#: First match wins.
MAGIC = (
    ("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("49492A00", "tiff"),
    ("4D4D002A", "tiff"), ("424D", "bmp"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"),
)
IMAGES = tuple("bmp jpeg pdf png tiff".split())
STRUCTURED = (*IMAGES, "ole", "zip")
PROMISES = {
    "pdf": ".pdf", "png": ".png", "jpeg": ".jpg .jpeg", "tiff": ".tif .tiff", "bmp": ".bmp", "eml": ".eml", "txt": ".txt .md",
    "csv": ".csv", "html": ".html .htm", "docx": ".docx", "xlsx": ".xlsx", "doc": ".doc", "xls": ".xls",
}


def latin(c: Column) -> Column:
    return F.decode(c, "ISO-8859-1")


def looks_like_header(line: Column) -> Column:
    """A Latin-1 line that begins like a mail header: 1 to 64 printable characters, then a colon."""
    return line.rlike(r"^[\x21-\x39\x3b-\x7e]{1,64}:")


def sniff(content: Column, whole_characters: bool = False) -> Column:
    """The label of the leading bytes.

    A character that the end of the head cuts in two counts as malformed; with
    whole_characters it is read to its end, so text is text wherever it is cut.
    """
    head = F.substring(content, 1, HEAD)
    chain = None
    for magic, label in MAGIC:
        hit = F.substring(content, 1, len(magic) // 2) == F.unhex(F.lit(magic))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    line = F.substring(F.substring_index(latin(head), "\n", 1), 1, 200)
    chain = chain.when(line.startswith("From ") | looks_like_header(line), "eml")
    valid = F.is_valid_utf8(head.cast("string"))
    for more in (1, 2, 3) if whole_characters else ():  # bytes of one character that may lie behind the head
        valid = valid | F.is_valid_utf8(F.substring(content, 1, HEAD + more).cast("string"))
    return chain.when(valid, "txt").otherwise("other")


def tamper(media: Column, content: Column) -> Column:
    """TAMPER_TRUNCATED, TAMPER_TRAILING_DATA or null from the last bytes of structured formats."""
    tail = latin(F.when(F.octet_length(content) > TAIL, F.substring(content, -TAIL, TAIL)).otherwise(content))
    cut, more = F.lit("TAMPER_TRUNCATED"), F.lit("TAMPER_TRAILING_DATA")
    after = lambda mark: F.substring_index(tail, mark, -1)
    bare = F.regexp_replace(tail, r"\x00+\z", "")
    pdf = F.when(~tail.contains("%%EOF"), cut).when(after("%%EOF").rlike(r"[^ \t\r\n\x00]"), more)
    png = F.when(~tail.contains("IEND"), cut).when(F.length(after("IEND")) > 4, more)
    jpeg = F.when(~bare.contains("ÿÙ"), cut).when(~bare.endswith("ÿÙ"), more)
    archive = F.when(~tail.contains("PK\u0005\u0006"), cut)
    return F.when(media == "pdf", pdf).when(media == "png", png).when(media == "jpeg", jpeg).when(media.isin("docx", "xlsx", "zip"), archive)


def promised(path: Column) -> Column:
    """What a path's extension promises, or null."""
    ext, chain = tx.extension(path), None
    for media, exts in PROMISES.items():
        hit = ext.isin(*exts.split())
        chain = F.when(hit, media) if chain is None else chain.when(hit, media)
    return chain


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out, and compiled, once: filters pushed through a projection would copy it at each use."""
    return F.transform(F.array(value), body)[0]


def classify(path: Column, content: Column, whole_characters: bool = False) -> Column:
    """struct<media_type, magic_label, reason>; reason is null for what is accepted.

    The content decides; an extension that promises another structured type, or
    text where the content is structured, is a mismatch.  whole_characters: see
    sniff().
    """
    def media(k: Column) -> Column:
        want, got = k["want"], k["got"]
        carrier = F.when(want.isin("docx", "xlsx"), "zip").when(want.isin("doc", "xls"), "ole").when(want.isin(*IMAGES), want)
        clash = F.coalesce(got != carrier, want.isNotNull() & got.isin(*STRUCTURED), F.lit(False))
        free = F.when(got.isin(*IMAGES, "eml", "txt"), got).otherwise("other")
        return F.struct(F.when(clash, got).otherwise(F.coalesce(want, free)).alias("media_type"), got.alias("magic_label"), clash.alias("clash"))

    def verdict(m: Column) -> Column:
        reason = F.when(m["clash"], "TAMPER_MAGIC_MISMATCH").otherwise(tamper(m["media_type"], content))
        return F.struct(m["media_type"].alias("media_type"), m["magic_label"].alias("magic_label"), reason.alias("reason"))

    return _let(_let(F.struct(promised(path).alias("want"), sniff(content, whole_characters).alias("got")), media), verdict)
