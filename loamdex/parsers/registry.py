"""Which parser reads a file: the first, in a fixed order, whose MIME types or extensions match."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loamdex.errors import ParseError
from loamdex.parsers import media, packed, plain, rich
from loamdex.parsers.base import Document
from loamdex.session import with_fields

Parse = Callable[[bytes, str | None, str | None], Document]


@dataclass(frozen=True)
class Parser:
    """A format: exact MIME types, beginnings of MIME types, extensions (in lower case; ``any_case`` accepts others)."""

    name: str
    parse: Parse
    mimes: frozenset[str] = frozenset()
    mime_starts: tuple[str, ...] = ()
    extensions: frozenset[str] = frozenset()
    any_case: bool = False

    def can_parse(self, mime: str | None, extension: str | None) -> bool:
        if mime and (mime in self.mimes or self.mime_starts and mime.startswith(self.mime_starts)):
            return True
        return bool(extension) and (extension.lower() if self.any_case else extension) in self.extensions


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


PARSERS: tuple[Parser, ...] = (
    Parser("image", media.image, mime_starts=media.IMAGE_MIMES, extensions=media.IMAGE_EXTENSIONS, any_case=True),
    Parser("pdf", rich.pdf, _set("application/pdf"), extensions=_set("pdf")),
    Parser("office", packed.office, packed.OFFICE_MIMES, extensions=_set("docx pptx")),
    Parser("epub", packed.epub, _set("application/epub+zip"), extensions=_set("epub")),
    Parser("spreadsheet", packed.sheets, packed.SHEET_MIMES, extensions=_set("xlsx xls ods")),
    Parser("archive", packed.archive, packed.ARCHIVE_MIMES, extensions=_set("zip tar gz tgz")),
    Parser("email", rich.mail, _set("message/rfc822 application/mbox"), extensions=_set("eml mbox")),
    Parser("notebook", rich.notebook, _set("application/x-ipynb+json"), extensions=_set("ipynb")),
    Parser("rtf", rich.rtf, _set("application/rtf text/rtf"), extensions=_set("rtf")),
    Parser("code", plain.code, plain.CODE_MIMES, extensions=plain.CODE_EXTENSIONS, any_case=True),
    Parser("data", plain.data, plain.DATA_MIMES, extensions=plain.DATA_EXTENSIONS),
    Parser("web", plain.web, mime_starts=plain.WEB_MIMES, extensions=plain.WEB_EXTENSIONS),
    Parser("audio", media.audio, mime_starts=media.AUDIO_MIMES, extensions=frozenset(media.AUDIO_LABELS), any_case=True),
    Parser("text", plain.text, mime_starts=plain.TEXT_MIMES, extensions=plain.TEXT_EXTENSIONS),
)


def parser_for(mime: str | None, extension: str | None, parsers: tuple[Parser, ...] = PARSERS) -> Parser | None:
    return next((p for p in parsers if p.can_parse(mime, extension)), None)


def parse(raw: bytes, mime: str | None = None, extension: str | None = None, parsers: tuple[Parser, ...] = PARSERS) -> Document:
    """Read a file; one of no known format is text if it is UTF-8, else an error."""
    found = parser_for(mime, extension, parsers)
    if found:
        return found.parse(raw, mime, extension)
    try:
        raw.decode()
    except UnicodeDecodeError as e:
        raise ParseError(f"unknown (mime={mime or 'none'}, ext={extension or 'none'})", "no parser for this type of file") from e
    return plain.text(raw, mime, extension)


PARSED = "text string, title string, language string, content_type string, metadata map<string,string>, parser string, error string"


def parsed(files: DataFrame, parsers: tuple[Parser, ...] = PARSERS) -> DataFrame:
    """``files`` (content, mime_type, extension, ...) with the columns of PARSED in place of ``content``.

    A file that can't be read has a null text and its ``error``; the others are not held up by it. One map
    stage; a file is read whole.
    """
    kept = [c for c in files.columns if c not in ("content", *(x.split()[0] for x in PARSED.replace("string,string", "").split(", ")))]
    rows = files.select(*kept, "content")
    schema = with_fields(rows.drop("content").schema, PARSED)
    kinds = {"text": pa.string(), "title": pa.string(), "language": pa.string(), "content_type": pa.string(), "metadata": pa.map_(pa.string(), pa.string()), "parser": pa.string(), "error": pa.string()}
    mime_at, extension_at = kept.index("mime_type"), kept.index("extension")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in kinds}
            for raw, mime, extension in zip(*(batch.column(i).to_pylist() for i in (len(kept), mime_at, extension_at)), strict=True):
                found = parser_for(mime, extension, parsers)
                try:
                    if raw is None:
                        raise ParseError("file", "no content")
                    d, error = parse(raw, mime, extension, parsers), None
                except Exception as e:
                    d, error = Document(None, None), str(e) or type(e).__name__  # type: ignore[arg-type]
                for name, value in (("text", d.text), ("title", d.title), ("language", d.language), ("content_type", d.content_type), ("metadata", list(d.metadata.items())), ("parser", found.name if found else "text"), ("error", error)):
                    out[name].append(value.encode("utf-8", "replace").decode() if isinstance(value, str) else value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[n], t) for n, t in kinds.items())], names=[*kept, *kinds])

    return rows.mapInArrow(read, schema)
