"""What a parser gives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TYPES = ("text", "code", "image", "audio", "data")
#: Tags that end a line when they stand without attributes, and the entities that are read.
LINE_TAGS = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "pre", "hr", "section", "article", "header", "footer")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


@dataclass
class Document:
    text: str
    content_type: str = "text"
    title: str | None = None
    language: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def lossy(raw: bytes) -> str:
    """Bytes as text; what isn't UTF-8 becomes the replacement character."""
    return raw.decode("utf-8", "replace")


def squeeze(text: str) -> str:
    """Each run of white space as one blank, or one line break if it begins with one; trimmed."""
    return re.sub(r"\s+", lambda m: "\n" if m.group()[0] == "\n" else " ", text).strip()


def unescape(text: str) -> str:
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return text


def lines_of(text: str) -> list[str]:
    """Lines by line feed, without a carriage return at their end; a break at the end of the text starts none."""
    parts = text.split("\n")
    if parts and not parts[-1]:
        parts.pop()
    return [p.removesuffix("\r") for p in parts]
