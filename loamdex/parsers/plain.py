"""Text, source code, structured data, and pages."""

from __future__ import annotations

import csv
import io
import json
import re
from decimal import Decimal

from loamdex.parsers.base import LINE_TAGS, Document, lines_of, lossy, squeeze, unescape

# What the formats are called.
TEXT_MIMES = ("text/plain", "text/markdown", "text/x-rst", "text/x-org")
TEXT_EXTENSIONS = frozenset("txt md markdown rst org log cfg ini conf".split())
CODE_MIMES = frozenset(
    """text/x-rust text/x-python text/javascript text/typescript text/x-go text/x-c text/x-c++ text/x-java text/x-ruby text/x-shellscript text/css text/x-sql
    text/x-r text/x-swift text/x-kotlin text/x-scala text/x-zig text/x-lua text/x-perl text/x-elixir text/x-erlang text/x-haskell text/x-ocaml text/x-protobuf
    text/x-terraform text/x-dockerfile""".split()
)
CODE_LANGUAGES = {
    "rust": "rs",
    "python": "py",
    "javascript": "js jsx",
    "typescript": "ts tsx",
    "go": "go",
    "c": "c h",
    "cpp": "cpp hpp cc cxx",
    "java": "java",
    "ruby": "rb",
    "bash": "sh bash",
    "zsh": "zsh",
    "fish": "fish",
    "css": "css",
    "sql": "sql",
    "r": "r",
    "swift": "swift",
    "kotlin": "kt kts",
    "scala": "scala",
    "zig": "zig",
    "lua": "lua",
    "perl": "pl pm",
    "elixir": "ex exs",
    "erlang": "erl hrl",
    "haskell": "hs",
    "ocaml": "ml mli",
    "protobuf": "proto",
    "terraform": "tf tfvars",
}
LANGUAGE_OF = {e: name for name, extensions in CODE_LANGUAGES.items() for e in extensions.split()}
CODE_EXTENSIONS = frozenset(LANGUAGE_OF) | {"dockerfile", "makefile", "cmake"}
DATA_MIMES = frozenset("application/json application/jsonlines application/toml application/yaml text/csv".split())
DATA_EXTENSIONS = frozenset("json jsonl toml yaml yml csv".split())
WEB_MIMES = ("text/html", "text/xml", "application/xml", "application/xhtml+xml")
WEB_EXTENSIONS = frozenset("html htm xml xhtml".split())

_TAG = re.compile(r"<[^>]*>|<[^>]*\Z|[^<]+", re.S)


def text(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    body = lossy(raw)
    title = next((s[2:].strip() for line in lines_of(body) if (s := line.strip()).startswith("# ")), None)
    return Document(body, "text", title)


def code(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    body = lossy(raw)
    return Document(body, "code", language=LANGUAGE_OF.get(extension or ""), metadata={"lines": str(len(lines_of(body)))})


def csv_text(body: str) -> str:
    """``header: value, header: value`` a row; values beyond the headers stand alone. Without rows the text as it is."""
    csv.field_size_limit(1 << 30)
    try:
        rows = [r for r in csv.reader(io.StringIO(body, newline="")) if r]
    except csv.Error:
        return body
    if len(rows) < 2:
        return body
    heads = rows[0]
    return "".join(", ".join(f"{heads[i]}: {v}" if i < len(heads) else v for i, v in enumerate(r)) + "\n" for r in rows[1:])


def flat_json(value: object) -> str:
    """``path.to[0].key: value`` a line for each leaf, keys sorted; a bare value without a path."""
    out: list[str] = []
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, v[k]) for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1)]
        else:
            leaf = (json.dumps(v, ensure_ascii=False).strip('"') if isinstance(v, str) else {True: "true", False: "false", None: "null"}.get(v, str(v)) if not isinstance(v, (int, float, Decimal)) or isinstance(v, bool) else str(v))
            out.append(f"{path}: {leaf}\n" if path else f"{leaf}\n")
    return "".join(out)


def _read_json(body: str) -> object:
    def refuse(name: str) -> object:
        raise ValueError(name)

    return json.loads(body, parse_constant=refuse)


def json_text(body: str) -> str:
    """The flattened document; text that is no JSON as it is."""
    try:
        return flat_json(_read_json(body))
    except (ValueError, RecursionError):
        return body


def jsonl_text(body: str) -> str:
    """Each line flattened and followed by an empty line; lines that are no JSON are skipped. If all are, the text as it is."""
    out = []
    for line in lines_of(body):
        try:
            out.append(flat_json(_read_json(line)) + "\n")
        except (ValueError, RecursionError):
            continue
    return "".join(out) or body


def data(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    body = lossy(raw)
    return Document({"csv": csv_text, "json": json_text, "jsonl": jsonl_text}.get(extension or "", str)(body), "data")


def html_text(page: str, line_tags: tuple[str, ...] = LINE_TAGS, with_title: bool = True) -> tuple[str, str | None]:
    """(text, title) of a page; without ``with_title`` the title stays in the text.

    Text of scripts and styles is left out. Tags without attributes among ``line_tags`` end a line. The
    title is what stands in titles up to the last one that is closed. A tag still open at the end is dropped.
    """
    state = {"script": False, "style": False, "title": False}
    out, head, title = [], [], None
    for token in _TAG.findall(page):
        if token[0] != "<":
            if with_title and state["title"]:
                head.append(token)
            elif not state["script"] and not state["style"]:
                out.append(token)
            continue
        if token[-1] != ">":
            continue
        name = token[token.rfind("<") + 1 : -1].lower()
        for of in state:
            if name.startswith(of):
                state[of] = True
                break
            if name.startswith("/" + of):
                state[of] = False
                if of == "title":
                    title = "".join(head).strip()
                break
        if name.lstrip("/") in line_tags:
            out.append("\n")
    return squeeze(unescape("".join(out))), title if with_title else None


def xml_text(page: str) -> str:
    """Each tag as a blank; no entity is read."""
    return squeeze(re.sub(r"<[^>]*\Z", "", re.sub(r"<[^>]*>|>", " ", page)))


def web(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    page = lossy(raw)
    if extension == "xml" or "xml" in (mime or ""):
        return Document(xml_text(page))
    body, title = html_text(page)
    return Document(body, "text", title)
