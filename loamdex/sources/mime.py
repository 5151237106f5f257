"""Types of files, by their first bytes and by their names."""

from __future__ import annotations

import re

# MIME types by extension.
MIME_EXTENSIONS = {
    "text/plain": "txt cfg ini conf log",
    "text/markdown": "md markdown",
    "text/x-rust": "rs",
    "text/x-python": "py",
    "text/javascript": "js jsx tsx",
    "text/typescript": "ts",
    "text/x-go": "go",
    "text/x-c": "c h",
    "text/x-c++": "cpp hpp cc cxx",
    "text/x-java": "java",
    "text/x-ruby": "rb",
    "text/x-shellscript": "sh bash zsh fish",
    "text/html": "html htm",
    "text/xml": "xml",
    "text/css": "css",
    "application/json": "json",
    "application/jsonlines": "jsonl",
    "application/toml": "toml",
    "application/yaml": "yaml yml",
    "text/csv": "csv",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "message/rfc822": "eml",
    "application/mbox": "mbox",
    "application/vnd.ms-excel": "xls",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "image/png": "png",
    "image/jpeg": "jpg jpeg",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "audio/flac": "flac",
    "application/zip": "zip",
    "application/x-tar": "tar",
    "application/gzip": "gz tgz",
    "text/x-rst": "rst",
    "text/x-org": "org",
    "text/x-sql": "sql",
    "text/x-r": "r",
    "text/x-swift": "swift",
    "text/x-kotlin": "kt kts",
    "text/x-scala": "scala",
    "text/x-zig": "zig",
    "text/x-lua": "lua",
    "text/x-perl": "pl pm",
    "text/x-elixir": "ex exs",
    "text/x-erlang": "erl hrl",
    "text/x-haskell": "hs",
    "text/x-ocaml": "ml mli",
    "text/x-protobuf": "proto",
    "text/x-terraform": "tf tfvars",
    "text/x-dockerfile": "dockerfile",
}
MIME_OF = {e: mime for mime, extensions in MIME_EXTENSIONS.items() for e in extensions.split()}

# First bytes of binary formats, (offset, bytes, type).
_MAGIC = (
    (0, b"\x89PNG\r\n\x1a\n", "image/png"),
    (0, b"\xff\xd8\xff", "image/jpeg"),
    (0, b"GIF8", "image/gif"),
    (8, b"WEBP", "image/webp"),
    (0, b"BM", "image/bmp"),
    (0, b"II*\0", "image/tiff"),
    (0, b"MM\0*", "image/tiff"),
    (0, b"\0\0\x01\0", "image/vnd.microsoft.icon"),
    (8, b"WAVE", "audio/x-wav"),
    (0, b"fLaC", "audio/x-flac"),
    (0, b"ID3", "audio/mpeg"),
    (0, b"\xff\xfb", "audio/mpeg"),
    (0, b"OggS", "audio/ogg"),
    (4, b"ftypM4A", "audio/m4a"),
    (0, b"%PDF", "application/pdf"),
    (0, b"{\\rtf", "application/rtf"),
    (257, b"ustar", "application/x-tar"),
    (0, b"\x1f\x8b", "application/gzip"),
    (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
)


def sniff(raw: bytes) -> str | None:
    """The type that the first bytes show, None for text and for what isn't known."""
    if raw[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        head = raw[:4096]
        if b"mimetypeapplication/epub+zip" in head:
            return "application/epub+zip"
        if b"mimetypeapplication/vnd.oasis.opendocument.spreadsheet" in head:
            return "application/vnd.oasis.opendocument.spreadsheet"
        for part, extension in ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx")):
            if part in head:
                return MIME_OF[extension]
        return "application/zip"
    for at, mark, mime in _MAGIC:
        if raw[at : at + len(mark)] == mark and not (mark == b"BM" and len(raw) < 26):
            return mime
    start = raw[:512].lstrip().lower()
    if start.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    return "text/xml" if start.startswith(b"<?xml") else None


def extension_of(path: str) -> str | None:
    """What follows the last dot of the name, unless that is its first character."""
    m = re.search(r"[^/]\.([^./]*)$", path)
    return m[1] if m and m[1] else None


def mime_of_name(path: str) -> str | None:
    """By the extension as it is written: capitals aren't known."""
    return MIME_OF.get(extension_of(path) or "")
