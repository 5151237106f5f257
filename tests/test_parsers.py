import gzip
import io
import json
import struct
import tarfile
import wave
import zipfile
import zlib

import pytest

from loamdex.errors import ParseError
from loamdex.parsers import media, packed, plain, rich
from loamdex.parsers.registry import PARSERS, parse, parsed, parser_for


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_text_and_title():
    d = parse(b"intro\n  # The Title \n# second", None, "md")
    assert (d.text, d.title, d.content_type) == ("intro\n  # The Title \n# second", "The Title", "text")
    assert parse(b"caf\xe9", "text/plain", None).text == "caf\ufffd"


def test_code():
    d = parse(b"fn a() {}\n\nfn b() {}\n", None, "rs")
    assert (d.content_type, d.language, d.metadata) == ("code", "rust", {"lines": "3"})
    assert parse(b"x", None, "Makefile").language is None and parse(b"x", None, "Makefile").content_type == "code"


def test_csv():
    assert plain.csv_text("name,score\nann,3\nbob,4,extra\n") == "name: ann, score: 3\nname: bob, score: 4, extra\n"
    assert plain.csv_text('a,b\n"x, y",2\n') == "a: x, y, b: 2\n"
    assert plain.csv_text("only,head") == "only,head" and plain.csv_text("") == ""


def test_json():
    body = json.dumps({"b": [1, {"c": None}], "a": {"d": True, "e": "x"}, "f": 1.5, "g": {}, "h": []})
    assert plain.json_text(body) == "a.d: true\na.e: x\nb[0]: 1\nb[1].c: null\nf: 1.5\n"
    assert plain.json_text('"bare"') == "bare\n" and plain.json_text("{broken") == "{broken" and plain.json_text("NaN") == "NaN"
    assert plain.jsonl_text('{"a":1}\n\nbroken\n{"b":2}') == "a: 1\n\nb: 2\n\n" and plain.jsonl_text("x\ny") == "x\ny"
    assert parse(b"a = 1\n", None, "toml").text == "a = 1\n"


def test_html():
    page = "<html><head><title> My <b>T</b> </title><style>p{}</style></head><body><h1>Head</h1><p>one &amp;lt; two</p><p class=x>three</p><script>if(a>b){}</script>a > b <br>end<open"
    text, title = plain.html_text(page)
    assert title == "My T" and text == "Head\none < two\nthree\na > b end"
    assert plain.html_text("<title>never closed")[1] is None
    assert plain.xml_text("<a>x<b/>y &amp; z</a>") == "x y &amp; z"
    assert parse(b"<r><t>q</t></r>", "application/xml", None).text == "q"


def test_docx_and_pptx():
    w = 'xmlns:w="http://w"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three &amp; four</w:t><w:br/><w:t>five</w:t></w:r></w:p></w:body></w:document>"
    assert parse(zipped(**{"word/document.xml": body}), None, "docx").text == "One\ttwo\nThree & four\nfive"

    def slide(*paragraphs):
        return '<p:sld xmlns:p="http://p" xmlns:a="http://a">' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in paragraphs) + "</p:sld>"

    deck = zipped(**{"ppt/slides/slide10.xml": slide("last"), "ppt/slides/slide2.xml": slide("first", "more"), "ppt/slides/_rels/x.xml": "<a/>"})
    assert parse(deck, None, "pptx").text == "--- Slide 1 ---\nfirst\nmore\n\n--- Slide 2 ---\nlast"
    for raw in (b"no zip", zipped(other="x")):
        with pytest.raises(ParseError):
            packed.docx(raw)


def test_epub():
    book = zipped(**{"b.xhtml": "<p>Second</p>", "a.xhtml": "<h1>First</h1><p>x</p>", "toc.xhtml": "<p>toc</p>", "content.opf": '<package xmlns:dc="http://dc"><dc:title> The Book </dc:title></package>', "empty.html": "<p></p>"})
    d = parse(book, "application/epub+zip", None)
    assert (d.text, d.title, d.metadata) == ("First\nx\n\nSecond", "The Book", {"chapter_count": "2"})


def test_sheets():
    m = 'xmlns="http://m" xmlns:r="http://r"'
    book = zipped(
        **{
            "xl/workbook.xml": f'<workbook {m}><sheets><sheet name="Data" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {m}><si><t>name</t></si><si><t>n</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c><c r="C2"><v>3.0</v></c></row><row/><row><c r="C4" t="b"><v>1</v></c></row></sheetData></worksheet>',
            "xl/worksheets/sheet2.xml": f"<worksheet {m}><sheetData/></worksheet>",
        }
    )
    d = parse(book, None, "xlsx")
    assert d.text == "--- Sheet: Data ---\nname: Anna, 1.5, n: 3\nn: true\n\n\n--- Sheet: Empty ---"
    assert d.content_type == "data" and d.metadata["sheet_count"] == "2"
    t = 'xmlns:table="http://t" xmlns:office="http://o" xmlns:text="http://x"'
    ods = zipped(**{"content.xml": f'<office:d {t}><table:table table:name="S"><table:table-row><table:table-cell><text:p>h</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell office:value-type="float" office:value="2"><text:p>2.0</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16000"/></table:table-row></table:table></office:d>'})
    assert parse(ods, None, "ods").text == "--- Sheet: S ---\nh: 2"
    with pytest.raises(ParseError):
        parse(b"\xd0\xcf\x11\xe0 old", None, "xls")


def test_archives():
    raw = zipped(**{"a.txt": "text", "b.bin": b"\xff\xfe\x00", "big.txt": "x" * ((1 << 20) + 1)})
    d = parse(raw, None, "zip")
    assert d.text == "--- file: a.txt ---\ntext\n--- file: b.bin (binary, 3 bytes) ---\n--- file: big.txt (skipped: too large) ---" and d.metadata["entry_count"] == "3"
    many = zipped(**{f"{i:02}.txt": "y" * (1 << 20) for i in range(12)})
    assert parse(many, None, "zip").text.endswith("--- truncated: total size limit reached ---")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert parse(out.getvalue(), None, "tar").text == "--- file: d/x.txt ---\nabc"
    assert parse(gzip.compress(out.getvalue()), None, "tgz").text == "--- file: d/x.txt ---\nabc"
    assert parse(gzip.compress(b"plain"), None, "gz").text == "plain"
    for bad, extension in ((gzip.compress(b"\xff\xfe"), "gz"), (b"junk", "gz"), (b"junk" * 200, "tar"), (b"junk", "zip")):
        with pytest.raises(ParseError):
            parse(bad, None, extension)


MAIL = b"Subject: Hello\nFrom: Ann <ann@x.example>\nTo: bob@x.example\nDate: Wed, 01 Jan 2025 10:00:00 +0200\n\nThe body.\n"


def test_mail():
    d = parse(MAIL, None, "eml")
    assert d.text == "Subject: Hello\nFrom: Ann <ann@x.example>\nTo: bob@x.example\nDate: 2025-01-01T10:00:00+02:00\n\nThe body." and d.title == "Hello"
    page = b"From: a@x.example\nContent-Type: text/html; charset=utf-8\n\n<p>  Gr\xc3\xbc\xc3\x9fe</p>\n\n  <b>next</b>\n"
    assert parse(page, None, "eml").text == "Subject: (no subject)\nFrom: a@x.example\n\nGrüße\nnext"
    box = b"From ann@x.example Wed Jan 1\n" + MAIL + b"\nFrom bob@x.example Thu Jan 2\nSubject: Re\n\nagain\n"
    d = parse(box, None, "mbox")
    assert d.text.startswith("--- Message 1 ---\nSubject: Hello\nFrom: Ann <ann@x.example>\nThe body.") and d.text.endswith("--- Message 2 ---\nSubject: Re\nagain") and d.metadata == {"message_count": "2"}
    d = parse(b"\nFrom x\nSubject: s\n\nb\n" * (rich.MAX_MESSAGES + 2), None, "mbox")
    assert d.metadata == {"message_count": "1000"} and d.text.endswith("--- truncated: 1000 message limit reached ---")


def test_notebook():
    book = {"metadata": {"kernelspec": {"language": "python"}}, "cells": [{"cell_type": "raw", "source": "no"}, {"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "1 + 1", "outputs": [{"output_type": "stream", "text": ["a\n"]}, {"output_type": "execute_result", "data": {"text/plain": "2"}}]}, {"cell_type": "code", "source": " "}]}
    d = parse(json.dumps(book).encode(), None, "ipynb")
    assert d.text == "--- markdown cell 2 ---\n# T\nx\n\n--- code cell 3 ---\n1 + 1\n--- output ---\na\n2" and (d.language, d.content_type, d.metadata) == ("python", "code", {"cell_count": "2"})
    for bad in (b"{", b"[]", b'{"cells": 3}', b"\xff"):
        with pytest.raises(ParseError):
            parse(bad, None, "ipynb")


def test_rtf():
    body = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info x}Hello \b bold\b0\par caf\'e9 \'93q\'94 \u8364? \{x\}\tab y\par\par\par\par end}"
    assert parse(body, None, "rtf").text == "Hello bold\ncafé “q” € {x}\ty\n\nend"
    with pytest.raises(ParseError):
        parse(b"plain", None, "rtf")


def pdf(*pages, pack=False):
    out = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages>> endobj\n"
    for i, p in enumerate(pages, 3):
        data = zlib.compress(p) if pack else p
        out += b"%d 0 obj <</Length %d%s>>\nstream\n%s\nendstream endobj\n" % (i, len(data), b" /Filter /FlateDecode" if pack else b"", data)
    return out


def test_pdf():
    first = rb"BT /F1 12 Tf 72 700 Td (Hello \(world\)) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ ET"
    for pack in (False, True):
        d = parse(pdf(first, b"BT <E9> Tj ET", pack=pack), None, "pdf")
        assert d.text == f"Hello (world)\nSecond line\n\n{rich.PAGE_BREAK}\n\né" and "size_bytes" in d.metadata
    assert rich.page_text("a  \nb\f\fc") == "a\nb\n\n--- Page Break ---\n\n\n\n--- Page Break ---\n\nc"
    for bad in (b"junk", b"%PDF-1.4 /Encrypt"):
        with pytest.raises(ParseError):
            parse(bad, None, "pdf")


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 4000, 3000) + b"\x08\x06\0\0\0"


def test_images():
    assert parse(PNG, None, "png").text == "Image file (PNG). 4000x3000 pixels. landscape orientation. high resolution. PNG lossless image"
    assert parse(b"GIF89a" + struct.pack("<HH", 10, 30) + b"\0" * 10, None, "gif").text == "Image file (GIF). 10x30 pixels. tall vertical image. thumbnail icon small. GIF image animation"
    assert media.image_size(b"BM" + b"\0" * 16 + struct.pack("<II", 7, 7) + b"\0" * 4) == (7, 7)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 50, 200) + b"\0" * 10
    assert media.image_size(jpeg) == (200, 50)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0/" + struct.pack("<I", 9 | 19 << 14) + b"\0" * 9
    assert media.image_size(lossless) == (10, 20)
    svg = parse(b"<svg><title>Logo</title><text x='1'>Big\n word</text></svg>", None, "svg")
    assert svg.text == "Image file (SVG). Logo. Big word. SVG vector graphic scalable" and svg.content_type == "image"
    assert parse(b"??", None, "ico").text == "Image file (ICO). icon favicon"


def test_audio():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 8000 * 4 * 65)
    d = parse(out.getvalue(), None, "wav")
    assert d.text == "Audio file (WAV). Sample rate: 8000 Hz. Stereo. Duration: 1:05. Codec: pcm_s16le" and d.metadata["duration_seconds"] == "65.00"
    assert media.duration(3723.4) == "1:02:03" and media.duration(59.6) == "1:00"
    assert parse(b"??", None, "ogg").text == "Audio file (OGG). Format could not be fully parsed. Size: 2 bytes"
    tag = b"\x03Song"
    mp3 = b"ID3\x03\0\0\0\0\0" + bytes([10 + len(tag)]) + b"TIT2" + struct.pack(">I", len(tag)) + b"\0\0" + tag + b"\xff\xfb\x90\x00" + b"\0" * 20
    assert parse(mp3, None, "mp3").title == "Song"


def test_skill():
    head, body = rich.skill('---\nname: do-it\ndescription: "When: needed"\nallowed-tools: a b\n# no\nnested:\n  x: 1\n---\n# Body\n')
    assert (head.name, head.description, head.allowed_tools, body) == ("do-it", "When: needed", "a b", "# Body\n") and "x" not in head.raw
    assert rich.skill("no head") is None and rich.skill("---\nname: x\n") is None


def test_order_of_the_registry():
    assert [p.name for p in PARSERS[-2:]] == ["audio", "text"]
    assert parser_for("text/html", "md").name == "web" and parser_for(None, "PY").name == "code" and parser_for(None, "MD") is None
    assert parse(b"plain", None, "unknown").content_type == "text"
    with pytest.raises(ParseError):
        parse(b"\xff\xfe\xfd", None, None)


def test_a_broken_file_does_not_hold_up_the_others(spark):
    rows = [("a", b"# T\nx", None, "md"), ("b", b"broken", None, "docx"), ("c", None, None, "md"), ("d", b"", None, "txt"), ("e", b"\xff", None, "qqq")]
    got = {r["uri"]: r for r in parsed(spark.createDataFrame(rows, "uri string, content binary, mime_type string, extension string")).collect()}
    assert (got["a"]["text"], got["a"]["title"], got["a"]["error"]) == ("# T\nx", "T", None)
    assert got["b"]["text"] is None and "docx" in got["b"]["error"] and got["c"]["error"] and got["d"]["text"] == "" and got["e"]["error"]


def test_parsers_of_random_bytes_only_raise_parse_errors():
    import random

    rng = random.Random(1)
    heads = [b"", b"PK\x03\x04", b"{\\rtf", b"%PDF-1.4 BT (", b"RIFF....WAVE", b"fLaC", b"ID3", b"\xff\xd8", b"<html>", b"From x\n", b"Subject: a\n\n", b"GIF8", b"{"]
    for p in PARSERS:
        for _ in range(40):
            raw = rng.choice(heads) + rng.randbytes(rng.randrange(200))
            for extension in p.extensions:
                try:
                    assert isinstance(p.parse(raw, None, extension).text, str)
                except ParseError:
                    pass
