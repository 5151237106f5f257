"""Chunks as rows to give away."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("uri", "text", "chunk_index", "content_type", "file_type", "title", "byte_range", "vector")


def export_rows(chunks: DataFrame, file_type: str | None = None, vectors: bool = False) -> DataFrame:
    """The exported fields of the chunks; ``byte_range`` as an array of two offsets, vectors only if asked for."""
    rows = chunks if file_type is None else chunks.where(F.col("file_type") == file_type)
    span = F.when(F.col("byte_range").isNotNull(), F.array("byte_range.start_off", "byte_range.end_off"))
    rows = rows.withColumn("byte_range", span) if dict(rows.dtypes)["byte_range"].startswith("struct") else rows
    return rows.select(*[c for c in FIELDS if vectors or c != "vector"])


def export_lines(chunks: DataFrame, file_type: str | None = None, vectors: bool = False) -> DataFrame:
    """(value): one JSON object a chunk; fields that are null are left out."""
    rows = export_rows(chunks, file_type, vectors)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_jsonl(chunks: DataFrame, path: str, file_type: str | None = None, vectors: bool = False) -> None:
    """The export as a folder of JSON lines, written in parallel."""
    export_lines(chunks, file_type, vectors).write.mode("overwrite").text(path)


def iterate_lines(chunks: DataFrame, file_type: str | None = None, vectors: bool = False) -> Iterator[str]:
    """The export line by line, a partition at a time on the driver."""
    for row in export_lines(chunks, file_type, vectors).toLocalIterator():
        yield row["value"]
