"""Formats that only a parser can read: mail, CSV shape and Office files, as vectorised functions."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.utils import getaddresses
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RECIPIENT

LOSSY = "invalid UTF-8: malformed bytes became U+FFFD"
_ROLES = {"From": "from", "Sender": "sender", "Reply-To": "reply_to", "To": "to", "Cc": "cc", "Bcc": "bcc"}


def _flat(value: object) -> str:
    if not value:
        return ""
    try:
        value = make_header(decode_header(str(value)))
    except Exception:  # an undecodable header is shown as it stands
        pass
    return re.sub(r"[\r\n]", " ", str(value)).strip()


def _body(part, warnings: list[str]) -> str | None:
    raw = part.get_payload(decode=True)
    if raw is None:
        if part.is_multipart():
            return None
        raw = str(part.get_payload()).encode("utf-8", "replace")
    charset = part.get_content_charset() or "utf-8"
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        warnings.append(f"unknown charset {charset}: read as UTF-8")
        return raw.decode("utf-8", "replace")


def read_mail(data: bytes) -> dict:
    """Headers as they stand (all values of each), addresses by role, and the plain-text parts."""
    warnings: list[str] = []
    m = message_from_bytes(data, policy=policy.compat32)
    headers: dict[str, list[str]] = {}
    for name in m.keys():
        headers.setdefault(name, [str(v) for v in m.get_all(name, [])])
    people = []
    for name, role in _ROLES.items():
        for shown, address in getaddresses([str(v) for v in m.get_all(name, [])]):
            if address:
                people.append({"role": role, "display_name": _flat(shown) or None, "address": address.strip().lower(), "raw": f"{shown} <{address}>".strip()})
    if m.is_multipart():
        texts = [_body(p, warnings) for p in m.walk() if p.get_content_maintype() == "text" and p.get_content_subtype() == "plain"]
    else:
        texts = [_body(m, warnings)]
    text = "\n".join(t for t in texts if t is not None)
    if "�" in text:
        warnings.append("lossy decode: U+FFFD in body")

    def as_sent(name: str) -> str | None:
        value = m.get(name)
        return None if value is None else str(value).strip() or None

    return {
        "text": text, "subject": _flat(m.get("Subject")) or None, "date_raw": as_sent("Date"),
        "message_id": as_sent("Message-ID"), "recipients": people, "raw_headers": headers, "warnings": warnings,
    }


_MAIL = f"text string, subject string, date_raw string, message_id string, recipients array<{RECIPIENT}>, raw_headers map<string,array<string>>, warnings array<string>"


def parse_mail(content: Column | str) -> Column:
    """A struct as read_mail() gives it."""
    return F.pandas_udf(_mail, _MAIL)(content)


def _mail(messages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in messages:
        yield pd.DataFrame([read_mail(bytes(x or b"")) for x in s], columns=["text", "subject", "date_raw", "message_id", "recipients", "raw_headers", "warnings"])


def table_shape(text: str) -> tuple[int, int, list[str]]:
    """(rows, most columns, warnings) of CSV text; quoted fields may span lines."""
    rows = cols = 0
    try:
        for row in csv.reader(io.StringIO(text)):
            rows, cols = rows + 1, max(cols, len(row))
    except csv.Error as e:
        return rows, cols, [f"csv shape unknown: {e}"]
    return rows, cols, []


def csv_shape(text: Column | str) -> Column:
    """struct<rows,cols,warnings> of CSV text."""
    return F.pandas_udf(_shape, "rows int, cols int, warnings array<string>")(text)


def _shape(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([table_shape(x or "") for x in s], columns=["rows", "cols", "warnings"])


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_docx(data: bytes) -> str:
    """Paragraphs and tables in the order of the body; a table's cells are separated by tabs."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = []
    for e in [] if body is None else body:
        if e.tag == f"{_W}p":
            lines.append(words(e))
        elif e.tag == f"{_W}tbl":
            lines += ["\t".join("\n".join(words(p) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
    return "\n".join(lines)


def cell_text(value: object) -> str:
    """A cell as text on one line: empty for none, upper-case booleans, ISO dates."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).upper()
    shown = value.isoformat() if hasattr(value, "isoformat") else str(value)
    return re.sub(r"[\t\r\n]", " ", shown)


def read_xlsx(data: bytes) -> list[tuple[str, str, int, int]]:
    """(sheet, tab-separated text, rows, most columns) of each sheet; formulas stay source text."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in e.iter(f"{_S}t")) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    names = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    parts = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for name, part in zip(names, parts):
        lines, cols = [], 0
        for row in ElementTree.fromstring(z.read(part)).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_S}c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value, formula = c.find(f"{_S}v"), c.find(f"{_S}f")
                kind = c.get("t")
                if formula is not None:
                    got: object = "=" + (formula.text or "")
                elif kind == "inlineStr":
                    got = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif value is None:
                    got = None
                elif kind == "s":
                    got = shared[int(value.text)]
                else:
                    got = value.text == "1" if kind == "b" else value.text
                cells[at or len(cells) + 1] = cell_text(got)
            width = max(cells, default=0)
            lines.append("\t".join(cells.get(i, "") for i in range(1, width + 1)))
            cols = max(cols, width)
        out.append((name, "\n".join(lines), len(lines), cols))
    return out


def _office(kind: str, data: bytes) -> dict:
    try:
        if kind == "docx":
            return {"pages": [{"page_number": None, "text": read_docx(data)}], "tables": [], "warnings": []}
        sheets = read_xlsx(data)
        return {
            "pages": [{"page_number": i, "text": s[1]} for i, s in enumerate(sheets, 1)],
            "tables": [{"name": s[0], "page_number": i, "rows": s[2], "cols": s[3]} for i, s in enumerate(sheets, 1)], "warnings": [],
        }
    except Exception as e:  # an unreadable file is reported, and the other rows go on
        return {"pages": [], "tables": [], "warnings": [f"{kind} unreadable: {type(e).__name__}"]}


_OFFICE = "pages array<struct<page_number:int,text:string>>, tables array<struct<name:string,page_number:int,rows:int,cols:int>>, warnings array<string>"


def parse_office(kind: Column | str, content: Column | str) -> Column:
    """struct<pages,tables,warnings> of docx and xlsx files."""
    return F.pandas_udf(_files, _OFFICE)(kind, content)


def _files(kinds: pd.Series, files: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_office(k, bytes(f or b"")) for k, f in zip(kinds, files)], columns=["pages", "tables", "warnings"])
