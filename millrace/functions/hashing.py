"""Hashes, canonical JSON and identifiers, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION

_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def canonical(value: object) -> str:
    """Canonical JSON on the driver: sorted names, no blanks, no ASCII escapes, nulls kept."""
    return _ENCODER.encode(value)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def json_string(c: Column) -> Column:
    """A JSON string literal as canonical() writes it; null for null.

    Spark's to_json writes control characters as \\u001F where canonical JSON has
    \\u001f, so free text is escaped here.  Texts without such characters take
    the short way.
    """
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(_SHORT.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), escaped).otherwise(out), F.lit('"'))


def canonical_json(**fields: Column | tuple[Column, str]) -> Column:
    """A canonical JSON object of columns: strings as they are, or (column, "raw") for numbers and made-up JSON."""
    parts = []
    for name in sorted(fields):
        value = fields[name]
        text = value[0].cast("string") if isinstance(value, tuple) else json_string(value)
        parts += [F.lit(("," if parts else "{") + json.dumps(name, ensure_ascii=False) + ":"), F.coalesce(text, F.lit("null"))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def sha256(c: Column) -> Column:
    """Hexadecimal SHA-256 of text (its UTF-8 bytes) or binary."""
    return F.sha2(c, 256)


def chunk_config_sha(target: int, overlap: int, schema_version: str = SCHEMA_VERSION) -> str:
    return sha256_json({"target": target, "overlap": overlap, "schema_version": schema_version})


def chunk_id(source: Column, extraction: Column, config: Column, channel: Column, page: Column, start: Column, end: Column, text_sha: Column, schema_version: str = SCHEMA_VERSION) -> Column:
    return sha256(canonical_json(
        source_sha256=source, extraction_sha256=extraction, chunk_config_sha256=config, channel=channel, page_number=(page, "raw"),
        char_start=(start, "raw"), char_end=(end, "raw"), text_sha256=text_sha, schema_version=F.lit(schema_version),
    ))


def fingerprint(kind: Column, key: Column) -> Column:
    """The first 16 hexadecimal digits of the hash of {key, kind}."""
    return F.substring(sha256(canonical_json(kind=kind, key=key)), 1, 16)


def vault_path(sha: Column) -> Column:
    return F.concat(F.lit("evidence/sha256/"), F.substring(sha, 1, 2), F.lit("/"), sha)
