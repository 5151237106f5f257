"""Text as column expressions: terms, folding, patterns, snippets."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits.
RUN = r"[\p{IsAlphabetic}\p{N}]+"
#: Letters and digits with the marks that combine with them.
MARKED_RUN = r"[\p{L}\p{N}\p{M}]+"


def terms_of(text: str | Column) -> Column:
    """The terms of a text with repetition, lower case; the length test (two bytes) applies before folding."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return F.transform(F.filter(runs, lambda x: F.octet_length(x) >= 2), F.lower)


@cache
def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that are a plain letter with marks, and those plain letters."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    pairs = {a: b for a, b in plain.items() if a != b and b.isascii()}
    return "".join(pairs), "".join(pairs.values())


def folded(text: str | Column) -> Column:
    """Lower case, without diacritics."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(F.translate(column, *_accents())), r"\p{M}", "")


def folded_tokens(text: str | Column) -> Column:
    """Tokens of the full-text engine: runs of letters and digits, folded; any length."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold(text: str) -> list[str]:
    """The same tokens of a string on the driver, for queries."""
    marks = str.maketrans(*_accents())
    plain = "".join(c for c in text.translate(marks).lower() if unicodedata.category(c)[0] != "M")
    return re.findall(r"[^\W_]+", plain)


def query_terms(text: str) -> list[str]:
    """The terms of a query string, as :func:`terms_of` has them of a column."""
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "") if len(w.encode()) >= 2]


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression for the whole string; ``*`` crosses slashes. None if it is no glob.

    ``*`` any run, ``?`` one character, ``[...]`` and ``[!...]`` one of a set, ``{a,b}`` either. An
    unclosed set or brace is no glob.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
            i += len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inside[1:] if inside[:1] in "!^" else inside) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append("." if c == "?" else re.escape(c))
        i += 1
    return None if depth else f"(?s)^{''.join(out)}$"


def path_matches(uri: str | Column, pattern: str) -> Column:
    """Whether the path of a uri (without file://) matches a glob; an invalid glob is a substring of the uri."""
    column = F.col(uri) if isinstance(uri, str) else uri
    regex = glob_regex(pattern)
    return column.contains(pattern) if regex is None else F.regexp_replace(column, "^file://", "").rlike(regex)


def snippet(text: str | Column, chars: int = 120) -> Column:
    """The first characters of a text on one line."""
    return F.translate(F.substring(text, 1, chars), "\n", " ")


def line_count(text: str | Column) -> Column:
    """Lines of a text; a line break at its end starts none."""
    column = F.col(text) if isinstance(text, str) else text
    body = F.regexp_replace(column, r"\n\z", "")
    return F.when(column == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)


def heading(text: str | Column) -> Column:
    """The first line that starts with a hash and a blank, without them; null where there is none."""
    found = F.regexp_extract(text, r"(?m)^[^\S\n]*# (.*)$", 1)
    has = F.regexp_like(text, F.lit(r"(?m)^[^\S\n]*# "))
    return F.when(has, F.trim(F.regexp_replace(found, r"\s+$", "")))


def squeezed(text: Column) -> Column:
    """Each run of white space as one blank, or one line break if it begins with one; trimmed."""
    blanks = F.regexp_replace(text, r"(?U)(?<!\s)[\s&&[^\n]]\s*", " ")
    return F.regexp_replace(F.regexp_replace(blanks, r"(?U)(?<!\s)\n\s*", "\n"), r"(?U)^\s+|\s+$", "")


def xml_text(xml: str | Column) -> Column:
    """The text of an XML document: each tag a blank; no entity is read."""
    column = F.col(xml) if isinstance(xml, str) else xml
    return squeezed(F.regexp_replace(F.regexp_replace(column, r"<[^>]*>|>", " "), r"<[^>]*\z", ""))
