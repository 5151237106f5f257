"""Cutting texts that are too long into pieces of a bounded number of UTF-8 bytes.

Method: recursive bisection. A span longer than the limit minus the overlap is cut at the strongest
boundary in its middle half (paragraph, line, sentence, word; of equal ones the nearest to the
midpoint), or between two characters where there is none, and both halves are cut again until they
fit. Then each piece but the first is led in by the overlap: the end of the text before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Natural places from best to worst; the cut comes after the mark.
MARKS = (b"\n\n", b"\n", b". ", b"! ", b"? ", "。".encode(), b" ")
#: Bytes of a piece that are not overlap, at least: one UTF-8 character.
LEAST_ROOM = 4
PIECE = "piece_index int, text string, byte_range struct<start_off: bigint, end_off: bigint>"


def _char_start(raw: bytes, at: int, step: int) -> int:
    """The first character start from ``at`` on, in the direction of ``step``."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def _cut(raw: bytes, start: int, end: int) -> int:
    mid, quarter = (start + end) // 2, (end - start) // 4
    for mark in MARKS:
        left = raw.rfind(mark, start + quarter, mid)
        right = raw.find(mark, max(start, mid - len(mark)), end - quarter)
        cuts = [x + len(mark) for x in (left, right) if x >= 0 and start < x + len(mark) < end]
        if cuts:
            return min(cuts, key=lambda x: abs(x - mid))
    at = _char_start(raw, mid, -1)
    return at if at > start else _char_start(raw, mid, 1)


def split_bytes(raw: bytes, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most ``size`` bytes, neighbours share up to ``overlap``.

    A piece begins ``overlap`` bytes before its predecessor ends, or at the next character start. An
    overlap that leaves less than LEAST_ROOM bytes of the size for new text is cut to leave them.
    Only a single character of more bytes than ``size`` makes a longer piece.
    """
    if len(raw) <= size:
        return [(0, len(raw))]
    size = max(1, size)
    overlap = max(0, min(overlap, size - LEAST_ROOM))
    room, todo, bodies = size - overlap, [(0, len(raw))], []
    while todo:
        start, end = todo.pop()
        cut = _cut(raw, start, end) if end - start > room else end
        if start < cut < end:
            todo += [(cut, end), (start, cut)]
        else:
            bodies.append((start, end))
    return [(_char_start(raw, max(0, start - overlap), 1) if i else start, end) for i, (start, end) in enumerate(bodies)]


def split_oversized(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(chunk_id, piece_index, text, byte_range, source_range) of every chunk above its chunk_size.

    ``byte_range`` are bytes of the chunk's text; ``source_range`` is the same moved by the start of
    the chunk's own byte_range, null where the chunk has none. Chunks whose text is null, fits, or
    whose content_type has no profile or a null chunk_size give no pieces; a null chunk_overlap is 0.
    Of repeated profiles of a content_type the smallest size counts. Repeated chunks are split each.
    One map stage: texts are not shuffled, and only those too long reach Python.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start_off", pa.int64()), ("end_off", pa.int64())])
        kinds = pa.schema([("chunk_id", pa.int64()), ("piece_index", pa.int32()), ("text", pa.string()), ("byte_range", span), ("source_range", span)])
        for batch in batches:
            for k in range(batch.num_rows):  # one text at a time: a long one makes many pieces
                r = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                raw, at = r["text"].encode(), r["at"]
                rows = []
                for i, (a, b) in enumerate(split_bytes(raw, r["chunk_size"], r["chunk_overlap"])):
                    source = None if at is None else {"start_off": at + a, "end_off": at + b}
                    rows.append({"chunk_id": r["chunk_id"], "piece_index": i, "text": raw[a:b].decode(), "byte_range": {"start_off": a, "end_off": b}, "source_range": source})
                yield pa.RecordBatch.from_pylist(rows, kinds)

    # A row for each kind of content; the planner broadcasts it by its size.
    profile = profiles.where(F.col("chunk_size").isNotNull() & F.col("content_type").isNotNull()).groupBy("content_type").agg(F.min(F.struct("chunk_size", F.coalesce("chunk_overlap", F.lit(0)).alias("chunk_overlap"))).alias("p"))
    long = chunks.select("chunk_id", "content_type", "text", F.col("byte_range.start_off").alias("at")).join(profile, "content_type").where(F.octet_length("text") > F.col("p.chunk_size"))
    return long.select("chunk_id", "text", "at", "p.*").mapInArrow(split, f"chunk_id bigint, {PIECE}, source_range struct<start_off: bigint, end_off: bigint>")


def oversized(pieces: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that :func:`split_oversized` cut into more than one piece, once each."""
    return pieces.where(F.col("piece_index") == 1).select("chunk_id").distinct()
