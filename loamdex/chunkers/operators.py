"""The chunkers over a table of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.chunkers.code import code
from loamdex.chunkers.plain import Chunks, fixed, recursive, semantic
from loamdex.session import with_fields

STRATEGIES = ("auto", "fixed", "semantic", "recursive", "code")
CHUNK = "chunk_index int, text string, byte_range struct<start_off: bigint, end_off: bigint>"


def chunk_text(text: str, content_type: str | None, file_type: str | None, size: int, overlap: int, strategy: str = "auto") -> Chunks:
    """By meaning for text and for code of unknown language, along definitions for code, by characters for everything else."""
    if strategy == "auto":
        strategy = {"code": "code", "text": "semantic"}.get(content_type or "text", "fixed")
    if strategy == "code":
        return code(text, size, overlap, file_type)
    return {"fixed": fixed, "semantic": semantic, "recursive": recursive}[strategy](text, size, overlap)


def chunked(documents: DataFrame, size: int = 512, overlap: int = 64, strategy: str = "auto") -> DataFrame:
    """One row a chunk: the columns of ``documents`` but its text, then chunk_index, text and byte_range.

    ``byte_range`` ends the chunk's own length after its start, though trimming and headings shift what it
    covers. Null and empty texts have no chunks. One map stage.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    kept = [c for c in documents.columns if c not in ("text", "chunk_index", "byte_range")]
    rows = documents.where(F.length("text") > 0).select(*kept, "text")
    types = {c: kept.index(c) if c in kept else None for c in ("content_type", "file_type")}
    schema = with_fields(rows.drop("text").schema, CHUNK)
    span = pa.struct([("start_off", pa.int64()), ("end_off", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            kinds = [batch.column(at).to_pylist() if at is not None else [None] * len(texts) for at in types.values()]
            for i, text in enumerate(texts):
                found = chunk_text(text, kinds[0][i], kinds[1][i], size, overlap, strategy)
                take = pa.array([i] * len(found), pa.int64())
                columns = [c.take(take) for c in batch.columns[:-1]]
                ranges = [{"start_off": at, "end_off": at + len(t.encode())} for t, at in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(found)), pa.int32()), pa.array([t for t, _ in found], pa.string()), pa.array(ranges, span)], names=[*kept, "chunk_index", "text", "byte_range"])

    return rows.mapInArrow(cut, schema)
