"""Scalar functions against plain Python on odd inputs."""

import hashlib
import io
import json
import pathlib
import random
import struct
import zipfile

import pytest
from plain import canonical
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import content, hashing, markup, parsers
from millrace.functions import text as tx

PDF = b"%PDF-1.5\nbody of a page\n%%EOF\n"
PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 20 + struct.pack(">I", 0) + b"IEND\xaeB`\x82"
JPEG = b"\xff\xd8\xff\xe0abc\xff\xd9"


def office(kind):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if kind == "docx":
            z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>compliance attestation</w:t></w:r></w:p>'
                       "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        else:
            ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
            z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Q" sheetId="1"/></sheets></workbook>')
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>operating</t></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1000</v></c></row>'
                       '<row><c r="A2" t="b"><v>1</v></c><c r="C2"><f>HYPERLINK("x")</f><v>0</v></c></row></sheetData></worksheet>')
    return out.getvalue()


DOCX, XLSX = office("docx"), office("xlsx")
CASES = [
    ("a.pdf", PDF, "pdf", None), ("a.png", PNG, "png", None), ("a.jpg", JPEG, "jpeg", None), ("a.docx", DOCX, "docx", None), ("a.xlsx", XLSX, "xlsx", None), ("a.txt", b"plain", "txt", None),
    ("a.pdf", PDF[:-8], "pdf", "TAMPER_TRUNCATED"), ("a.pdf", PDF + b"EXFILTRATED", "pdf", "TAMPER_TRAILING_DATA"), ("a.png", PNG + b"\0hidden", "png", "TAMPER_TRAILING_DATA"),
    ("a.png", PNG[:-8], "png", "TAMPER_TRUNCATED"), ("a.jpg", JPEG + b"x", "jpeg", "TAMPER_TRAILING_DATA"), ("a.jpg", JPEG[:-2], "jpeg", "TAMPER_TRUNCATED"), ("a.jpg", JPEG + b"\0\0", "jpeg", None),
    ("b.pdf", b"text", "txt", "TAMPER_MAGIC_MISMATCH"), ("b.txt", PNG, "png", "TAMPER_MAGIC_MISMATCH"), ("b.docx", b"text", "txt", "TAMPER_MAGIC_MISMATCH"), ("b.csv", PNG, "png", "TAMPER_MAGIC_MISMATCH"),
    ("c.docx", DOCX[:-30], "docx", "TAMPER_TRUNCATED"), ("c.html", b"%PDF-1.7", "pdf", "TAMPER_MAGIC_MISMATCH"), ("c.eml", b"no header", "eml", None), ("c.md", b"# x", "txt", None),
    ("noext", b"From me", "eml", None), ("noext", b"Subject: x\n", "eml", None), ("noext", b"http://x", "eml", None), ("noext", b"two words: x", "txt", None), ("noext", b"\xff\xfe\xfa", "other", None),
    ("noext", DOCX, "other", None), ("old.doc", bytes.fromhex("d0cf11e0a1b11ae1") + b"rest", "doc", None), ("old.xls", DOCX, "zip", "TAMPER_MAGIC_MISMATCH"), ("x.txt", b"a\xff\xfeb", "txt", None),
    ("noext", b"a" * 8191 + "é".encode(), "other", None), ("noext", b"II*\0tiff", "tiff", None), ("noext", b"BMxx", "bmp", None),
]


def test_classification(spark):
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _, _) in enumerate(CASES)], "i int, p string, c binary")
    got = {r["i"]: (r["k"]["media_type"], r["k"]["reason"]) for r in df.select("i", content.classify(F.col("p"), F.col("c")).alias("k")).collect()}
    assert got == {i: (m, r) for i, (_, _, m, r) in enumerate(CASES)}


def test_a_character_may_be_read_beyond_the_head(spark):
    n = content.HEAD
    texts = [b"a" * (n - k) + c.encode() + tail for c in "aé€😀" for k in range(5) for tail in (b"", b" more")]
    broken = [b"a" * (n - 1) + c for c in (b"\xff", b"\xc3", b"\xc3a", b"\xe2\x82", b"\xf0\x9f\x98a", b"\xa9")] + [b"\xff" + b"a" * n, b"a" * (n - 9) + b"\xffb" + "é".encode() * 9]
    late = [b"a" * n + c for c in (b"\xff", b"\xa9", b"\xc3")]  # what lies wholly behind the head isn't looked at
    df = spark.createDataFrame([(i, c) for i, c in enumerate(texts + broken + late)], "i int, c binary")
    rows = df.orderBy("i").select(content.sniff(F.col("c"), whole_characters=True), content.sniff(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["txt"] * len(texts) + ["other"] * len(broken) + ["txt"] * len(late)

    def plain(head):
        try:
            return head.decode() and "txt"
        except UnicodeDecodeError:
            return "other"

    assert [r[1] for r in rows] == [plain(c[:n]) for c in texts + broken + late]


def test_extension(spark):
    names = ["a.TXT", "a.tar.GZ", ".bashrc", "dir.x/file", "a.", "b/.h.txt", "x", "..", "n.p/q.r"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(tx.extension(F.col("p"))).collect()]
    want = [pathlib.PurePosixPath(n).suffix.lower() for n in names]
    assert [g for g, n in zip(got, names) if n != "a."] == [w for w, n in zip(want, names) if n != "a."]


def plain_spans(t, target, overlap):
    out, s, n = [], 0, len(t)
    while n:
        e = min(s + target, n)
        if e < n:
            for k in range(e, max(e - max(1, target // 5), s), -1):
                if t[k - 1].isspace():
                    e = k
                    break
        out.append((s, e))
        if e >= n:
            return out
        s = max(e - overlap, s + 1)
    return out


@pytest.mark.parametrize("target,overlap", [(40, 5), (7, 6), (1, 0), (50, 45), (2000, 200)])
def test_window_spans(spark, target, overlap):
    rng = random.Random(target)
    odd = ["a", "b", " ", "\n", "é", "😀", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​"]
    texts = ["", None, "x" * target, "y" * (3 * target), " " + "z" * (2 * target)] + ["".join(rng.choice(odd) for _ in range(rng.randrange(6 * min(target, 60)))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.window_spans(F.col("t"), target, overlap).alias("s")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["s"] is None if t is None else [tuple(x) for x in r["s"]] == plain_spans(t, target, overlap)


def test_window_parameters():
    for target, overlap in ((0, 0), (-1, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            tx.check_window(target, overlap)


def test_blank(spark):
    values = ["", " ", "\x1c\x1f", "\x85\xa0　 ", "​", "a", " a "]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(tx.is_blank(F.col("t"))).collect()]
    assert got == [not v.strip() for v in values]


def test_canonical_json(spark):
    values = ["plain", 'q"\\', "".join(map(chr, range(32))), "\x7f é 😀  ", "", None, "</x>"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(hashing.canonical_json(text=F.col("t"), n=(F.col("i"), "raw"), Z=F.lit("a"))).collect()]
    assert got == [canonical({"text": v, "n": i, "Z": "a"}) for i, v in enumerate(values)]


def test_fingerprint(spark):
    got = spark.range(1).select(hashing.fingerprint(F.lit("drop"), F.lit("É\x1f"))).first()[0]
    assert got == hashlib.sha256(canonical({"kind": "drop", "key": "É\x1f"}).encode()).hexdigest()[:16]


def test_guards(spark):
    cells = ["=cmd()", "+1", "-1", "@x", "\tx", "\rx", "x=1", "", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(tx.csv_guard(F.col("c"))).collect()]
    assert got == ["'" + c if c and c[0] in "=+-@\t\r" else c for c in cells]
    paths = {"a/b": False, "../a": True, "/a": True, "a//b": True, "a/./b": True, "a/..b": False, "..%2fb": False, "a/": True}
    got = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.path_is_unsafe(F.col("p"))).collect()}
    assert got == paths


def test_decoding_replaces_malformed_bytes(spark):
    raw = [b"prefix \xff\xfe\xfa suffix\n", b"\xe2\x82", b"ok \xc3\xa9", b"\xed\xa0\x80", b""]
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, b binary").orderBy("i").select(tx.decoded(F.col("b"))).collect()]
    assert got == [b.decode("utf-8", "replace") for b in raw]


def test_html():
    page = "<html><head><title> Q3  Filing</title><style>p{}</style></head><body><!-- no --><p>A &amp; B<br>c</p><script>x('</p>')</script><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    text, title, skipped, remarks, warnings = markup.read_html(page)
    assert (text, title, skipped, remarks) == ("A & B\nc\n\n\t1\t2", "Q3 Filing", 2, 1) and all(w.startswith("html:") and "excluded" in w for w in warnings)
    assert markup.read_html("<p>a<script>var unclosed")[0] == "a"
    assert markup.read_html("<template><p>no</p></template>yes")[0].strip() == "yes"
    assert markup.read_html("") == ("", None, 0, 0, [])


def test_mail():
    m = parsers.read_mail(
        b'From: "ceo@company.com" <Mallory@Evil.example>\nTo: a@x, B <b@x>\nCc: c@x\nDate: Fri, 31 Dec 1969 00:00:00 +0000\nDate: 2031\nSubject: =?utf-8?b?w4l0w6k=?=\nMessage-ID: <1@x>\nContent-Type: text/plain; charset=nope\n\nb\xc3\xb6dy')
    assert [(p["role"], p["address"]) for p in m["recipients"]] == [("from", "mallory@evil.example"), ("to", "a@x"), ("to", "b@x"), ("cc", "c@x")]
    assert m["subject"] == "Été" and m["raw_headers"]["Date"] == ["Fri, 31 Dec 1969 00:00:00 +0000", "2031"] and m["text"] == "bödy" and "nope" in m["warnings"][0]
    multi = b'From: x\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\none\n--B\nContent-Type: text/html\n\n<p>no\n--B\nContent-Type: text/plain\nContent-Disposition: attachment\n\ntwo\n--B--\n'
    assert parsers.read_mail(multi)["text"].split() == ["one", "two"]
    assert parsers.read_mail(b"")["text"] == ""


def test_tables_and_office(spark):
    assert parsers.table_shape('a,b,c\n"x\ny",2\n') == (2, 3, []) and parsers.table_shape("") == (0, 0, [])
    assert parsers.read_docx(DOCX) == "compliance attestation\na\tb"
    assert parsers.read_xlsx(XLSX) == [("Q", 'operating\t1000\nTRUE\t\t=HYPERLINK("x")', 2, 3)]
    assert parsers._office("docx", b"junk")["warnings"]
    assert [parsers.cell_text(v) for v in (None, True, 1.5, "a\tb\nc")] == ["", "TRUE", "1.5", "a b c"]


def test_closed_schema(spark):
    ddl = "a int, b struct<c:string>, d array<struct<e:int>>"
    lines = ['{"a":1}', '{"a":1,"z":2}', '{"a":"zero"}', '{"b":{"c":"x","y":1}}', '{"d":[{"e":1},{"f":2}]}', "[1]", "no", '{"a":2,"b":{"c":"x"},"d":[{"e":3}]}']
    got = schemas.schema_violations(spark.createDataFrame([(x,) for x in lines], "value string"), ddl).collect()
    assert [r["valid"] for r in got] == [True, False, False, False, False, False, False, True]
    assert [r["unknown"] for r in got][1] == ["z"] and [r["unknown"] for r in got][3] == ["b.y"] and [r["unknown"] for r in got][4] == ["d.f"]


def test_windows_of_long_texts_take_linear_time(spark):
    """Four times the text, about four times the time; pieces and byte offsets are those of plain slicing."""
    import time

    from millrace.operators import chunking

    took = []
    for n in (400_000, 1_600_000):
        text = ("wörter und 漢字 " * (n // 14))[:n]
        df = spark.createDataFrame([(1, text)], "i int, text string")
        began = time.perf_counter()
        rows = sorted(chunking.pieces(df).collect(), key=lambda r: r["char_start"])
        took.append(time.perf_counter() - began)
        assert all(r["piece"] == text[r["char_start"] : r["char_end"]] for r in rows) and rows[-1]["char_end"] == len(text)
        for r in rows[:: len(rows) // 5]:
            assert r["utf8_byte_start"] == len(text[: r["char_start"]].encode()) and r["utf8_byte_end"] == len(text[: r["char_end"]].encode())
    assert took[1] < 12 * max(took[0], 0.5), took
