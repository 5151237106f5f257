"""The best rows for each of many queries, block by block: a dense tile of scores at a time, and no row passed on that can't be among them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes that are gathered to one block.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 16 << 20
#: A row number after all others: no row.
NONE = np.iinfo(np.int64).max
#: Half a unit of the six digits that scores have, and a little.
HALF = 6e-7


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (uri, chunk_index, ...) put together to blocks, each in the order of uri and chunk_index, nulls first."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield _ordered(held)
            held, rows, size = [], 0, 0
    if rows:
        yield _ordered(held)


def _ordered(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    one = pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(c) for b in batches]) for c in batches[0].schema.names], names=batches[0].schema.names)
    return one.take(pc.sort_indices(one, sort_keys=[("uri", "ascending"), ("chunk_index", "ascending")], null_placement="at_start"))


class Best:
    """The ``k`` best rows of each query, by score, then by row number. A score that is not a number is above all."""

    def __init__(self, queries: int, k: int):
        self.k = max(1, k)
        self.score = np.full((queries, self.k), -np.inf)
        self.row = np.full((queries, self.k), NONE)

    def bound(self, at: slice, tile: np.ndarray, first: bool) -> np.ndarray:
        """What a score must reach, for each query of ``at``, to be among the best of those seen and, if it is the ``first``, of ``tile``."""
        least = self.score[at, -1]
        if first and tile.shape[1] >= self.k:
            some = tile[:, : max(512, self.k)]
            least = np.maximum(least, np.partition(some, some.shape[1] - self.k, axis=1)[:, -self.k])
        return least

    def part(self, which: np.ndarray) -> Best:
        """The best so far of some of the queries, to go on with."""
        one = Best(0, self.k)
        one.score, one.row = self.score[which], self.row[which]
        return one

    def offer(self, at: slice, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Rounded scores of rows for queries counted from the start of ``at``; a row comes once for a query."""
        least, last = self.score[at, -1][query], self.row[at, -1][query]
        better = (score > least) | ((score == least) & (row < last))
        n = len(self.score[at])
        q = np.r_[np.repeat(np.arange(n), self.k), query[better]]
        r, s = np.r_[self.row[at].ravel(), row[better]], np.r_[self.score[at].ravel(), score[better]]
        order = np.lexsort((r, -s, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], np.arange(n))[q[order]]
        kept = order[place < self.k]
        self.row[at], self.score[at] = r[kept].reshape(n, self.k), s[kept].reshape(n, self.k)

    def found(self, ids: pa.Array, block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(query_id, uri, chunk_index, score) of the best rows of ``block``."""
        query, place = np.nonzero(self.row != NONE)
        row, score = self.row[query, place], self.score[query, place]
        score[np.isposinf(score)] = np.nan
        for i in range(0, len(query), 50_000):
            part = slice(i, i + 50_000)
            take = pa.array(row[part])
            columns = [ids.take(pa.array(query[part])), block.column("uri").take(take), block.column("chunk_index").take(take), pa.array(score[part])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "uri", "chunk_index", "score"])
