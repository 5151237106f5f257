"""Results as text. Only the few rows of a page come here."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

SNIPPET, RADIUS, TRUNCATED = 120, 2, 200


def bare_path(uri: str) -> str:
    return uri.removeprefix("file://")


def size_text(n: int) -> str:
    """Bytes with one decimal in the largest unit up to GB."""
    if n < 1024:
        return f"{n}B"
    x = float(n)
    for unit in ("KB", "MB", "GB"):
        x /= 1024
        if x < 1024 or unit == "GB":
            return f"{x:.1f}{unit}"
    raise AssertionError


def round2(x: float) -> float:
    """Two digits, halves away from zero."""
    return float(Decimal(str(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def shortened(text: str, chars: int = TRUNCATED) -> str:
    """The first characters and three dots, if it has more bytes than that."""
    return text if len(text.encode()) <= chars else text[:chars] + "..."


def _lines(path: str) -> list[bytes] | None:
    try:
        with open(path, "rb") as f:
            return f.read().splitlines(keepends=True)
    except OSError:
        return None


def _line_at(lines: Sequence[bytes], offset: int) -> int | None:
    end = 0
    for i, line in enumerate(lines):
        end += len(line)
        if offset < end:
            return i
    return None


def context(uri: str, byte_range: Sequence[int] | None, radius: int = RADIUS, mark: bool = True) -> list[str] | None:
    """Numbered lines around the start of a byte range, that one marked; None if the file or range is missing."""
    if not uri.startswith("file://") or byte_range is None or (lines := _lines(bare_path(uri))) is None:
        return None
    at = _line_at(lines, byte_range[0])
    if at is None:
        return None
    shown = range(max(0, at - radius), min(len(lines), at + radius + 1))
    sign = {True: ">", False: " "}
    return [f"{i + 1:>4}{sign[mark and i == at]}{lines[i].decode('utf-8', 'replace').rstrip('\r\n')}" for i in shown]


def line_range(uri: str, byte_range: Sequence[int] | None) -> str:
    """``first-last`` line of a byte range, empty if the file or range is missing."""
    if byte_range is None or (lines := _lines(bare_path(uri))) is None:
        return ""
    raw = b"".join(lines)
    return "-".join(str(len(raw[: min(b, len(raw))].splitlines())) for b in byte_range[:2])


def _public(row: dict) -> dict:
    kept = {k: row.get(k) for k in ("uri", "text", "score", "chunk_index", "content_type", "file_type", "title")}
    span = row.get("byte_range")
    if span is not None:
        kept["byte_range"] = [span["start_off"], span["end_off"]]
    return {k: v for k, v in kept.items() if v is not None}


def format_results(rows: Sequence[dict], kind: str = "human", with_context: bool = False) -> str:
    """The hits as json, csv (uri as it is, score with four decimals) or for people."""
    if kind == "json":
        return json.dumps([_public(r) for r in rows], indent=2, ensure_ascii=False)
    if kind == "csv":
        out = ["uri,score,chunk_index,file_type,text"]
        for r in rows:
            quoted = (r["text"] or "").replace('"', '""').replace("\n", " ")
            out.append(f'{r["uri"]},{r["score"]:.4f},{r["chunk_index"]},{r["file_type"]},"{quoted}"')
        return "\n".join(out)
    if not rows:
        return "No results found."
    parts = []
    for i, r in enumerate(rows, 1):
        span = r.get("byte_range")
        lines = context(r["uri"], (span["start_off"], span["end_off"]) if span else None) if with_context else None
        body = lines or [(r["text"] or "")[:SNIPPET].replace("\n", " ")]
        parts.append("\n".join([f"  {i}. {bare_path(r['uri'])}  {r['score']:.2f}", *(f"     {line}" for line in body)]))
    return "\n\n".join(parts)
