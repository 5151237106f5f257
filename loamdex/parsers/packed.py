"""Formats that are archives of other files: office documents, books, sheets, and archives themselves."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterable
from datetime import datetime, timedelta
from itertools import zip_longest
from xml.etree import ElementTree as ET

from loamdex.errors import ParseError
from loamdex.parsers.base import LINE_TAGS, Document
from loamdex.parsers.plain import html_text

#: Bytes read of one entry of an archive, and of all of them; messages say where something is left out.
MAX_ENTRY, MAX_TOTAL = 1 << 20, 10 << 20
# What the formats are called.
OFFICE_MIMES = frozenset({"application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.presentationml.presentation"})
SHEET_MIMES = frozenset({"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel", "application/vnd.oasis.opendocument.spreadsheet"})
ARCHIVE_MIMES = frozenset({"application/zip", "application/x-tar", "application/gzip"})
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError)
#: The first day of a sheet's calendar.
DAY_ZERO = datetime(1899, 12, 30)


def _open(raw: bytes, kind: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except BROKEN as e:
        raise ParseError(kind, f"can't be opened as an archive: {e}") from e


def _events(xml: bytes, kind: str) -> Iterable[tuple[str, ET.Element]]:
    """(event, element) with namespaces cut off; ends where the XML is broken."""
    try:
        for event, e in ET.iterparse(io.BytesIO(xml), ("start", "end")):
            yield event, e
    except ET.ParseError:
        return


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def docx(raw: bytes) -> Document:
    """Runs of text; a new paragraph starts a line once there is text, breaks and tabs are kept."""
    with _open(raw, "docx") as z:
        try:
            xml = z.read("word/document.xml")
        except (KeyError, *BROKEN) as e:
            raise ParseError("docx", "word/document.xml is missing") from e
    out, filled = [], False
    for event, e in _events(xml, "docx"):
        name = _name(e)
        if event == "end" and name == "t":
            out.append(e.text or "")
            filled = filled or bool(e.text)
        elif event == "start" and name == "p":
            out.append("\n" if filled else "")
            filled = False
        elif event == "start" and name in ("tab", "br"):
            out.append("\t" if name == "tab" else "\n")
    return Document("".join(out).strip())


def _slide(xml: bytes) -> str:
    """The lines of a slide's paragraphs that have text."""
    lines: list[list[str]] = [[]]
    for event, e in _events(xml, "pptx"):
        if event == "start" and _name(e) == "p":
            lines.append([])
        elif event == "end" and _name(e) == "t":
            lines[-1].append(e.text or "")
    return "\n".join(t for t in map("".join, lines) if t).strip()


def pptx(raw: bytes) -> Document:
    with _open(raw, "pptx") as z:
        number = {n: int(m[1] or 0) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d*)[^/]*\.xml", n))}
        slides = [f"--- Slide {i} ---\n{_slide(z.read(n))}" for i, n in enumerate(sorted(number, key=number.__getitem__), 1)]
    return Document("\n\n".join(slides).strip())


def office(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    return pptx(raw) if extension == "pptx" else docx(raw)


def epub(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    """The chapters by name, without tables of contents; the title of the package."""
    tags = tuple(t for t in LINE_TAGS if t not in ("header", "footer"))
    with _open(raw, "epub") as z:
        pages = sorted(n for n in z.namelist() if re.search(r"\.(xhtml|html?)$", n, re.I) and not re.search("toc|nav", n, re.I))
        chapters = []
        for n in pages:
            try:
                body = z.read(n).decode()
            except (UnicodeDecodeError, *BROKEN):
                continue
            if found := html_text(body, tags, with_title=False)[0]:
                chapters.append(found)
        package = next((n for n in z.namelist() if n.endswith(".opf")), None)
        title = None
        if package:
            title = next((t for event, e in _events(z.read(package), "epub") if event == "end" and _name(e) == "title" and (t := (e.text or "").strip())), None)
    return Document("\n\n".join(chapters), "text", title, metadata={"chapter_count": str(len(chapters))})


def _number(value: str) -> str:
    """Whole numbers without a fraction."""
    x = float(value)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    def tree(name: str) -> ET.Element | None:
        return ET.fromstring(z.read(name)) if name in z.namelist() else None

    book, links, shared, styles = (tree(f"xl/{n}") for n in ("workbook.xml", "_rels/workbook.xml.rels", "sharedStrings.xml", "styles.xml"))
    target = {e.get("Id"): e.get("Target", "") for e in (links if links is not None else ())}
    strings = ["".join(t.text or "" for t in s.iter() if _name(t) == "t") for s in (shared if shared is not None else ())]
    custom = {} if styles is None else {e.get("numFmtId"): e.get("formatCode", "") for e in styles.iter() if _name(e) == "numFmt"}
    cells = [e.get("numFmtId") for part in (styles if styles is not None else ()) if _name(part) == "cellXfs" for e in part]
    dates = {i for i, f in enumerate(cells) if f and (14 <= int(f) <= 22 or re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(f, ""))))}
    out = []
    for e in book.iter():
        if _name(e) != "sheet":
            continue
        path = target.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), ""), "")
        sheet = tree(path.lstrip("/") if path.startswith("/") else f"xl/{path}")
        rows = []
        for row in sheet.iter() if sheet is not None else ():
            if _name(row) != "row":
                continue
            values: list[str] = []
            for c in row:
                at = _column(c.get("r", "")) if c.get("r") else len(values)
                kind = c.get("t", "n")
                inner = {_name(x): x for x in c}
                raw = (inner["v"].text or "") if "v" in inner else ""
                if kind == "s" and raw:
                    raw = strings[int(raw)] if int(raw) < len(strings) else ""
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in c.iter() if _name(t) == "t")
                elif kind == "b":
                    raw = "true" if raw == "1" else "false"
                elif kind == "e":
                    raw = f"#ERR:{raw}"
                elif kind == "n" and raw:
                    raw = str(DAY_ZERO + timedelta(days=float(raw))) if int(c.get("s", -1)) in dates else _number(raw)
                values += [""] * (at + 1 - len(values))
                values[at] = raw
            rows.append(values)
        out.append((e.get("name", ""), rows))
    return out


def _ods(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    def attribute(e: ET.Element, name: str) -> str | None:
        return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)

    out = []
    for t in ET.fromstring(z.read("content.xml")).iter():
        if _name(t) != "table":
            continue
        rows = []
        for r in t.iter():
            if _name(r) != "table-row":
                continue
            values: list[str] = []
            for c in r:
                if _name(c) not in ("table-cell", "covered-table-cell"):
                    continue
                kind = attribute(c, "value-type")
                value = "\n".join("".join(p.itertext()) for p in c if _name(p) == "p")
                if kind in ("float", "percentage", "currency"):
                    value = _number(attribute(c, "value") or "0")
                elif kind in ("date", "time", "boolean"):
                    value = attribute(c, f"{kind}-value") or value
                # Empty cells up to the sheet's edge are written as one with a large count.
                values += [value] * (int(attribute(c, "number-columns-repeated") or 1) if value else min(1024, int(attribute(c, "number-columns-repeated") or 1)))
            while values and not values[-1]:
                values.pop()
            times = int(attribute(r, "number-rows-repeated") or 1)
            rows += [values] * (times if values else min(1, times))
        out.append((attribute(t, "name") or "", rows))
    return out


def sheets(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    """``header: value, ...`` a row under the name of its sheet; empty cells are left out. The old binary format is an error."""
    with _open(raw, "spreadsheet") as z:
        try:
            book = _ods(z) if "content.xml" in z.namelist() else _xlsx(z)
        except (ET.ParseError, AttributeError, KeyError, ValueError, *BROKEN) as e:
            raise ParseError("spreadsheet", f"can't be read: {e}") from e
    parts = []
    for name, rows in book:
        while rows and not any(rows[0]):
            rows = rows[1:]
        heads = rows[0] if rows else []
        lines = [", ".join(f"{h}: {v}" if h else v for h, v in zip_longest(heads[: len(r)], r, fillvalue="") if v) for r in rows[1:]]
        parts.append("".join(f"{x}\n" for x in [f"--- Sheet: {name} ---", *filter(None, lines)]))
    return Document("\n\n".join(parts).rstrip(), "data", metadata={"sheet_count": str(len(book)), "size_bytes": str(len(raw))})


def _listing(entries: Iterable[tuple[str, int, object]]) -> tuple[str, int]:
    """The text of (name, size, reader) entries under their names, and how many there are."""
    out, total, count = [], 0, 0
    for name, size, read in entries:
        if total >= MAX_TOTAL:
            out.append("\n--- truncated: total size limit reached ---\n")
            break
        if size > MAX_ENTRY:
            out.append(f"--- file: {name} (skipped: too large) ---\n")
            count += 1
            continue
        try:
            body = read(min(MAX_TOTAL - total, MAX_ENTRY))
        except (*BROKEN, tarfile.TarError):
            continue
        count += 1
        try:
            found = body.decode()
        except UnicodeDecodeError:
            out.append(f"--- file: {name} (binary, {len(body)} bytes) ---\n")
            continue
        out.append(f"--- file: {name} ---\n{found}" + ("" if found.endswith("\n") else "\n"))
        total += len(body)
    return "".join(out).rstrip(), count


def _zip_entries(z: zipfile.ZipFile) -> Iterable[tuple[str, int, object]]:
    for info in z.infolist():
        if not info.is_dir():
            yield info.filename, info.file_size, lambda n, i=info: z.open(i).read(n)


def _tar_entries(t: tarfile.TarFile) -> Iterable[tuple[str, int, object]]:
    try:
        for m in t:
            if not m.isdir():
                yield m.name, m.size, lambda n, m=m: (t.extractfile(m).read(n) if m.isfile() else b"")
    except (tarfile.TarError, *BROKEN):
        return


def _gunzip(raw: bytes, kind: str) -> bytes:
    try:
        return gzip.GzipFile(fileobj=io.BytesIO(raw)).read(MAX_TOTAL)
    except BROKEN as e:
        raise ParseError(kind, f"can't be decompressed: {e}") from e


def archive(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    """The text files of an archive under their names; of a single compressed file, its text."""
    if extension == "gz":
        try:
            body, count = _gunzip(raw, "gz").decode(), 1
        except UnicodeDecodeError as e:
            raise ParseError("gz", "its content is no UTF-8 text") from e
    elif extension in ("tar", "tgz"):
        packed = _gunzip(raw, "tgz") if extension == "tgz" else raw
        try:
            body, count = _listing(_tar_entries(tarfile.open(fileobj=io.BytesIO(packed))))
        except (tarfile.TarError, *BROKEN) as e:
            raise ParseError("tar", f"can't be read: {e}") from e
    else:
        with _open(raw, "zip") as z:
            body, count = _listing(_zip_entries(z))
    return Document(body, metadata={"entry_count": str(count), "size_bytes": str(len(raw))})
