"""Vector search over chunks: exact and by cells, for one query or for a table of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loamdex.functions.vector import cosine, literal
from loamdex.operators.best import HALF, Best, blocks
from loamdex.session import with_fields

#: Query vectors that are sent to all tasks at once; larger sets go in blocks of this size.
QUERY_BLOCK = 10_000
#: Queries and chunks that are multiplied at once.
TILE = 512, 4096
#: The index is fitted on at most so many vectors.
SAMPLE_ROWS, MAX_CELLS = 100_000, 4096


def vector_search(chunks: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The ``k`` chunks of the highest cosine, with ``score``; equal scores (six digits) by uri and chunk_index.

    Zero, null and other-length vectors score 0 and keep their place in the ranking; negative scores
    are hits too. ``k`` = 0 returns every chunk. Sorted within tasks first, so only k rows a task move.
    """
    scored = chunks.withColumn("score", F.round(cosine("vector", literal(query)), 6)).orderBy(F.desc("score"), "uri", "chunk_index")
    return scored if k == 0 else scored.limit(k)


def vector_batch(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, uri, chunk_index, score, place) for a bounded set of (query_id, vector) against all chunks.

    Queries are taken in blocks of QUERY_BLOCK. A block is sent to every task, which multiplies it with
    its chunks tile by tile and passes on its own k best; these are ranked per query.
    """
    asked = queries.where(F.size("vector") > 0).select("query_id", "vector").toArrow()
    schema = StructType([queries.schema["query_id"], chunks.schema["uri"], chunks.schema["chunk_index"], StructField("score", DoubleType())])
    parts = [_block(chunks, asked.slice(b, QUERY_BLOCK), k, schema) for b in range(0, max(1, asked.num_rows), QUERY_BLOCK)]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "uri", "chunk_index")
    return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _vectors(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) for each length in a column of vectors; those that are null or hold a null have length 0."""
    values = lists.flatten()
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    ends = np.cumsum(sizes)
    holes = np.r_[0, np.cumsum(np.asarray(values.is_null()))]
    length, flat = np.where(holes[ends] == holes[ends - sizes], sizes, 0), np.asarray(values.fill_null(0.0))
    for d in np.unique(length).tolist():
        at = np.nonzero(length == d)[0]
        yield d, at, flat[(ends - sizes)[at][:, None] + np.arange(d)]


def _block(chunks: DataFrame, asked: pa.Table, k: int, schema: StructType) -> DataFrame:
    ids, lists = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in asked.columns)
    groups = [(d, ids.take(pa.array(at)), wanted) for d, at, wanted in _vectors(lists)]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            of = {d: (at, rows) for d, at, rows in _vectors(block.column("vector")) if d}
            for d, names, wanted in groups:
                at, rows = of.get(d, (np.zeros(0, np.int64), np.zeros((0, d), np.float32)))
                yield from _nearest(wanted, at, rows, block.num_rows, k).found(names, block)

    return chunks.select("uri", "chunk_index", "vector").mapInArrow(best, schema)


def _nearest(wanted: np.ndarray, at: np.ndarray, rows: np.ndarray, n: int, k: int) -> Best:
    """The ``k`` best of ``n`` rows for each of ``wanted``: those ``at`` have the vectors ``rows``, the others score 0.

    Tiles of products in single precision tell which pairs can matter; only those are computed in double
    precision. Vectors that aren't finite have no number as their score, and rank above all.
    """
    best = Best(len(wanted), k)
    mine, theirs = (np.einsum("ij,ij->i", x, x, dtype=float) for x in (wanted, rows))
    real, plain, odd = np.isfinite(mine) & (mine > 0), np.isfinite(theirs) & (theirs > 0), ~np.isfinite(theirs)

    def alike(which: np.ndarray, above: np.ndarray, level: np.ndarray) -> None:
        """For all of these queries: rows without a number, then rows of score 0."""
        row = np.r_[above[: best.k], level[: best.k]][: best.k]
        best.row[which, : len(row)], best.score[which, : len(row)] = row, np.where(np.arange(len(row)) < len(above), np.inf, 0.0)

    def without(some: np.ndarray) -> np.ndarray:
        return np.setdiff1d(np.arange(n), some, assume_unique=True)

    alike(~np.isfinite(mine), at, without(at))
    alike(mine == 0, at[odd], without(at[odd]))
    alike(real, at[odd], without(at[plain | odd]))
    few, rows, theirs, wanted, mine = at[plain], rows[plain], theirs[plain], wanted[real], mine[real]
    if not (len(few) and len(wanted)):
        return best
    units, asked = ((x / np.sqrt(m)[:, None]).astype(np.float32) for x, m in ((rows, theirs), (wanted, mine)))
    margin, inner = 2 * (HALF + 6e-8 * (8 + rows.shape[1])), best.part(real)
    for a in range(0, len(few), TILE[1]):
        for b in range(0, len(asked), TILE[0]):
            tile = asked[b : b + TILE[0]] @ units[a : a + TILE[1]].T
            of = slice(b, b + len(tile))
            q, r = np.divmod(np.flatnonzero(tile >= (inner.bound(of, tile, a == 0) - margin).astype(np.float32)[:, None]), tile.shape[1])
            score = np.empty(len(q))
            for i in range(0, len(q), 20_000):
                x, y = q[i : i + 20_000] + b, r[i : i + 20_000] + a
                score[i : i + 20_000] = np.einsum("ij,ij->i", wanted[x], rows[y], dtype=float) / np.sqrt(mine[x] * theirs[y])
            inner.offer(of, q, few[r + a], np.round(score, 6))
    best.score[real], best.row[real] = inner.score, inner.row
    return best


def _scaled(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1)
    return np.where((norm > 0)[:, None], rows / np.where(norm > 0, norm, 1)[:, None], 0.0)


class CellIndex:
    """Approximate search: chunks are kept by the nearest of a set of centroids; a query looks into the nearest cells.

    Centroids are fitted on a sample of at most SAMPLE_ROWS vectors of one length, the first that the
    index sees; a chunk of another length is an error, as is a query. Zero and null vectors have no cell
    and are not found. The table can be stored partitioned by ``cell``, so that other cells aren't read.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, chunks: DataFrame, seed: int = 0) -> CellIndex:
        usable = chunks.where(F.size("vector") > 0).select("vector")
        n = usable.count()
        sample = usable.sample(min(1.0, 1.2 * SAMPLE_ROWS / max(1, n)), seed=seed).limit(SAMPLE_ROWS).collect() if n > SAMPLE_ROWS else usable.collect()
        rows = [r[0] for r in sample if any(r[0])]
        if len({len(r) for r in rows}) > 1:
            raise ValueError("vectors of several lengths in one index")
        x = _scaled(np.array(rows, float)) if rows else np.zeros((0, 0))
        k = max(1, min(MAX_CELLS, round(n**0.5), len(x)))
        rng = np.random.default_rng(seed)
        cells = x[rng.choice(len(x), k, replace=False)] if len(x) else x
        for _ in range(8 if len(x) else 0):
            home = (x @ cells.T).argmax(1)
            total = np.zeros_like(cells)
            np.add.at(total, home, x)
            cells = np.where(np.linalg.norm(total, axis=1)[:, None] > 0, _scaled(total), cells)
        return cls(cells)

    def save(self, path: str) -> None:
        """Write the centroids to a file; the chunks are a table of their own."""
        with open(path, "wb") as f:
            np.save(f, self.centroids)

    @classmethod
    def load(cls, path: str) -> CellIndex:
        with open(path, "rb") as f:
            return cls(np.load(f))

    def assign(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` plus ``cell``; null for null and zero vectors."""
        centroids, schema = self.centroids, with_fields(chunks.drop("cell").schema, "cell int")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column("vector").to_pylist()
                if any(v and len(v) != centroids.shape[1] for v in vectors):
                    raise ValueError(f"a vector of another length than {centroids.shape[1]}")
                full = [v or [0.0] * centroids.shape[1] for v in vectors]
                x = _scaled(np.array(full, float).reshape(len(full), -1))
                cell = (x @ centroids.T).argmax(1) if len(full) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32(), mask=~x.any(1))], names=[*batch.schema.names, "cell"])

        return chunks.drop("cell").mapInArrow(place, schema)

    def search(self, assigned: DataFrame, query: Sequence[float], k: int = 10, probes: int = 8) -> DataFrame:
        """The ``k`` best chunks of the ``probes`` nearest cells, scored exactly."""
        q = np.array(query, float)
        if len(q) != self.centroids.shape[1]:
            raise ValueError(f"the index has vectors of length {self.centroids.shape[1]}")
        near = np.argsort(-(self.centroids @ q), kind="stable")[:probes].tolist()
        return vector_search(assigned.where(F.col("cell").isin(near)), query, k).drop("cell")
