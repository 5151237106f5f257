"""Vectors as column expressions, sums in double precision; and vectors stored as bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.session import with_fields


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values: Sequence[float]) -> Column:
    """A constant vector of floats."""
    return F.array(*[F.lit(float(v)).cast("float") for v in values]).cast("array<float>")


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """-1 to 1; 0 for empty or null vectors, other lengths, or a vector of length zero."""
    a, b = _column(a), _column(b)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(0.0)


def normalised(a: str | Column) -> Column:
    """``a`` at length 1; a zero vector as it is."""
    a = _column(a)
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(a)


def truncated(a: str | Column, dimensions: int) -> Column:
    """The first ``dimensions`` values at length 1 again (nested representations)."""
    return normalised(F.slice(_column(a), 1, dimensions))


def zeros(dimensions: int = 768) -> Column:
    """What a chunk gets as its vector where there is no model."""
    return F.array_repeat(F.lit(0.0).cast("float"), dimensions)


def unpacked(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``df`` plus ``out``: the vector stored in ``raw`` as little-endian 32-bit floats.

    Null bytes are a null vector; bytes past the last whole value are left out. Whole batches are read at
    once, as expressions would take a value apart bit by bit.
    """
    kept = df.drop(out)
    at = kept.columns.index(raw)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else np.frombuffer(v, "<f4", len(v) // 4) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return kept.mapInArrow(read, with_fields(kept.schema, f"`{out}` array<float>"))
