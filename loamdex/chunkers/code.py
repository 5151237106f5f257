"""Chunks of source code along its top-level definitions.

Python is read with its own parser. Other languages are scanned line by line: a definition starts at a
line without indentation that begins with one of the language's keywords, and ends with the bracket
that closes what it opened (strings and comments skipped) or with its semicolon.
"""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from loamdex.chunkers.plain import Chunks, semantic

#: Languages by extension.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c", "java": "java"}
#: Text before the first and after the last definition is kept if it is longer than this.
LEAST_REST = 10

# What starts a definition: (pattern, label); the label's first group is the name, if it has one.
_RULES = {
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", "fn"),
        (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"),
        (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
        (r"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[^{]*?\s+for\s+)?([\w:]+(?:<[^{]*>)?)", "impl"),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "trait"),
        (r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "mod"),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static|type)\s+\w+|macro_rules!\s*\w+", ""),
    ],
    "javascript": [
        (r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(\w+)?", "fn"),
        (r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)", "class"),
        (r"(?:export\s+)?interface\s+(\w+)", "interface"),
        (r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum"),
        (r"export\s|(?:const|let)\s", ""),
    ],
    "go": [(r"func\s+(?:\([^)]*\)\s*)?(\w+)", "fn"), (r"type\s+\w+", "")],
    "c": [(r"(?:typedef\s+)?(?:struct|enum)\s+\w+", ""), (r"(?!(?:if|for|while|return|else|switch|#)\b)[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*$", "fn"), (r"[A-Za-z_][\w\s*]+[^;{}]*;", "")],
    "java": [
        (r"(?:@\w+\s+)*(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)", "class"),
        (r"(?:(?:public|private|protected|abstract|static)\s+)*interface\s+(\w+)", "interface"),
        (r"(?:(?:public|private|protected|static)\s+)*enum\s+(\w+)", "enum"),
    ],
}
_RULES["typescript"] = _RULES["javascript"]
_COMPILED = {k: [(re.compile(p), label) for p, label in v] for k, v in _RULES.items()}
# Strings, comments and brackets, in the order they are met.
_MARKS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`|[{}();]", re.S)


class Definition(NamedTuple):
    start: int
    end: int
    label: str


def _python(text: str) -> list[Definition]:
    lines = [0]
    for line in text.split("\n"):
        lines.append(lines[-1] + len(line.encode()) + 1)
    out = []
    for node in ast.parse(text).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            kind = "class" if isinstance(node, ast.ClassDef) else "fn"
            out.append(Definition(lines[first - 1], lines[node.end_lineno - 1] + node.end_col_offset, f"{kind} {node.name}"))
    return out


def _close(text: str, at: int) -> int:
    """The end of the definition that starts at ``at``: its closing brace, or a semicolon outside of any."""
    depth = 0
    for m in _MARKS.finditer(text, at):
        mark = m.group()
        if mark in ("{", "("):
            depth += 1
        elif mark in ("}", ")"):
            depth -= 1
            if depth <= 0 and mark == "}":
                return m.end()
        elif mark == ";" and depth == 0:
            return m.end()
    return len(text)


def _scanned(text: str, language: str) -> list[Definition]:
    out, skip_to, at = [], 0, 0
    for line in text.splitlines(keepends=True):
        if at >= skip_to and line[:1].strip():
            for pattern, label in _COMPILED[language]:
                if m := pattern.match(line.rstrip()):
                    end = _close(text, at)
                    if language == "go":  # no semicolons: a line without a bracket is a definition of its own
                        stop = text.find("\n", at)
                        if stop < 0 or not re.search(r"[{(]\s*$", text[at:stop]):
                            end = len(text) if stop < 0 else stop
                    name = m.group(1) if m.re.groups else None
                    out.append((at, end, f"{label} {name}" if label and name else label))
                    skip_to = end
                    break
        at += len(line)
    if text.isascii():
        return [Definition(*d) for d in out]
    return [Definition(len(text[:a].encode()), len(text[:b].encode()), label) for a, b, label in out]


def definitions(text: str, language: str) -> list[Definition]:
    """Top-level definitions in their order, as byte ranges; none where the text can't be read as the language."""
    if language == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
    return _scanned(text, language) if language in _COMPILED else []


def code(text: str, size: int = 512, overlap: int = 64, extension: str | None = None) -> Chunks:
    """Neighbouring definitions together up to ``size`` bytes, each chunk headed by a comment of what it holds.

    A chunk after the first begins with the lines that cover the last ``overlap`` bytes of the one
    before. Text between two chunks is in neither; that before the first and after the last definition is
    a chunk of its own if it is longer than LEAST_REST bytes. What is still too long, or no code that can
    be read, is cut by meaning. A text of at most ``size`` bytes is one chunk as it is.
    """
    size, overlap = max(1, size), min(overlap, size // 2)
    raw = text.encode()
    if not raw:
        return []
    if len(raw) <= size:
        return [(text, 0)]
    defs = definitions(text, LANGUAGES.get(extension or "", ""))
    if not defs:
        return semantic(text, size, overlap)
    groups: list[tuple[int, int, list[str]]] = []
    start, end, labels = defs[0].start, defs[0].end, [defs[0].label]
    for d in defs[1:]:
        if d.end - start <= size:
            end, labels = d.end, [*labels, d.label]
            continue
        groups.append((start, end, labels))
        lead = raw.rfind(b"\n", 0, end - overlap) + 1 if 0 < overlap < end else d.start
        start, end, labels = min(lead, d.start), d.end, [d.label]
    groups.append((start, end, labels))
    chunks: Chunks = []
    head = raw[: defs[0].start].decode().strip()
    if len(head.encode()) > LEAST_REST:
        chunks.append((head, 0))
    for start, end, labels in groups:
        body = raw[start:end].decode(errors="replace").strip()
        scope = ", ".join(x for x in labels if x)
        if body:
            chunks.append((f"// {scope}\n{body}" if scope else body, start))
    rest = raw[defs[-1].end :].decode().strip()
    if len(rest.encode()) > LEAST_REST:
        chunks.append((rest, defs[-1].end))
    return [(t, at + shift) for chunk, at in chunks for t, shift in ([(chunk, 0)] if len(chunk.encode()) <= size else semantic(chunk, size, overlap))]
