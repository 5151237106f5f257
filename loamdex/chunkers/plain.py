"""Chunkers for text of any kind: by characters, by meaning, by separators."""

from __future__ import annotations

import re

Chunks = list[tuple[str, int]]

#: Characters looked back for white space before a cut.
LOOK_BACK = 100
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Beginnings of a line that make it a definition.
DEFINITIONS = (b"fn ", b"def ", b"class ", b"pub fn ", b"pub struct ", b"impl ", b"func ", b"function ")
_SPACE_BEFORE = re.compile(r"(?s).*\s")


def _limits(size: int, overlap: int) -> tuple[int, int]:
    return max(1, size), min(overlap, size // 2)


def fixed(text: str, size: int = 512, overlap: int = 64) -> Chunks:
    """Windows of ``size`` characters, ended after the last white space of their last 100 ones.

    A text of at most ``size`` bytes is one chunk as it is. Chunks are trimmed, their offsets are those
    before trimming. The next window begins ``overlap`` characters before the end of the last; one that
    would not get past its predecessor's end takes the whole window, so every text comes to an end.
    """
    size, overlap = _limits(size, overlap)
    if not text:
        return []
    if len(text.encode()) <= size:
        return [(text, 0)]
    out: Chunks = []
    start = offset = 0
    while start < len(text):
        stop = min(start + size, len(text))
        end = stop
        if stop < len(text) and (m := _SPACE_BEFORE.match(text, max(0, stop - LOOK_BACK), stop)):
            end = m.end() if m.end() - overlap > start else stop
        piece = text[start:end].strip()
        if piece:
            out.append((piece, offset))
        if end >= len(text):
            break
        step = max(end - overlap if end > overlap else end, start + 1)
        offset += len(text[start:step].encode())
        start = step
    return out


def _down(raw: bytes, at: int) -> int:
    """``at``, or the start of the character it is inside of."""
    at = min(at, len(raw))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _boundary(raw: bytes, low: int, high: int) -> tuple[int, int]:
    """(position, worth) of the best place to split in [low, high): the first of the worthiest.

    100 an empty line, 95 a heading, 90 inside a definition's line after its keyword, 50 a line break,
    40 the full stop of a sentence, 10 a blank; 0 for none. The first of 90 or more is taken at once.
    """
    found: list[tuple[int, int]] = []
    for mark, worth, inside in ((b"\n\n", 100, 2), (b"\n#", 95, 3), (b"\n", 50, 1), (b". ", 40, 2), (b" ", 10, 1)):
        at = raw.find(mark, low, min(high - 1 + inside, len(raw)))
        # A heading needs a character after its hash.
        if 0 <= at < high and not (worth == 95 and at + 2 >= len(raw)):
            found.append((at, worth))
    line = raw.rfind(b"\n", 0, low) + 1
    while line < high:
        for word in DEFINITIONS:
            if raw.startswith(word, line) and (at := max(low, line + len(word))) < high and b"\n" not in raw[line:at]:
                at = next((i for i in range(at, high) if raw[i] & 0xC0 != 0x80), high)
                # At a line's own break the break counts if it is worth more.
                if at < high:
                    found.append((at, 90))
        nxt = raw.find(b"\n", line)
        line = nxt + 1 if 0 <= nxt else high
    strong = [f for f in found if f[1] >= 90]
    if strong:
        return min(strong, key=lambda f: (f[0], -f[1]))
    return max(found, key=lambda f: f[1], default=(high, 0))


def semantic(text: str, size: int = 512, overlap: int = 64) -> Chunks:
    """Windows of ``size`` bytes, split at the worthiest boundary of their last quarter.

    Line breaks at the split go to the chunk before; a sentence's full stop goes to the next. The next
    window begins after the first line break of the last ``overlap`` bytes, or without overlap where
    there is none. Chunks are trimmed, their offsets are those before trimming. A text of at most
    ``size`` bytes is one chunk as it is.
    """
    size, overlap = _limits(size, overlap)
    raw = text.encode()
    if not raw:
        return []
    if len(raw) <= size:
        return [(text, 0)]
    out: Chunks = []
    start = 0
    while start < len(raw):
        end = _down(raw, start + size)
        if end >= len(raw):
            if piece := raw[start:].decode().strip():
                out.append((piece, start))
            break
        at, worth = _boundary(raw, _down(raw, start + size * 3 // 4), end)
        if worth >= 50:
            while raw[at : at + 1] == b"\n":
                at += 1
        at = _down(raw, at if worth else end)
        if at <= start:
            # A window smaller than its first character takes all of it.
            at = next((i for i in range(start + 1, len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
        if piece := raw[start:at].decode().strip():
            out.append((piece, start))
        line = raw.find(b"\n", _down(raw, at - overlap), at) if at > overlap else -1
        start = max(line + 1, start + 1) if line >= 0 else at
        start = _down(raw, start) if raw[start : start + 1] and raw[start] & 0xC0 == 0x80 else start
    return out


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """``text`` cut at the first separator that occurs, neighbours put together again up to ``size`` bytes."""
    if len(text.encode()) <= size:
        return [text] if text else []
    separator = next((s for s in separators if s and s in text), "")
    if not separator:
        return [text[i : i + size] for i in range(0, len(text), size)]
    finer = separators[separators.index(separator) + 1 :]
    out: list[str] = []
    held = ""
    for part in text.split(separator):
        joined = f"{held}{separator}{part}" if held else part
        if len(joined.encode()) <= size:
            held = joined
            continue
        if held:
            out.append(held)
        held = ""
        if len(part.encode()) > size:
            out += _pieces(part, size, finer)
        else:
            held = part
    return [*out, held] if held else out


def recursive(text: str, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> Chunks:
    """Cut at the coarsest separator, pieces still too long at the next; the last ``overlap`` characters of a piece lead in the next.

    So a chunk may be longer than ``size`` by the overlap. The offset is where the piece without its
    overlap is found again, less the overlap. Chunks of white space alone are dropped.
    """
    size, overlap = _limits(size, overlap)
    if not text:
        return []
    if len(text.encode()) <= size:
        return [(text, 0)]
    pieces = _pieces(text, size, tuple(separators))
    out: Chunks = []
    seen = 0
    for i, piece in enumerate(pieces):
        lead = pieces[i - 1][-overlap:] if i and overlap else ""
        at = text.find(piece, seen)
        if at >= 0:
            seen = at + (0 if i and overlap else len(piece))
        chars = max(0, at if at >= 0 else seen)
        offset = max(0, len(text[:chars].encode()) - len(lead.encode()))
        if (chunk := lead + piece).strip():
            out.append((chunk, offset))
    return out
