"""Pairs of rows with similar vectors, by an inverted file with product-quantised residuals.

Method: the vectors of one collection and length are assigned to the cells of a spherical k-means
trained on a bounded sample. A vector lives in its nearest cell, where it is kept as the product
code of its residual to the centroid, and visits the next nearest ones as a query. In a cell each
query gets a table of its products with every code word; sums over the codes (asymmetric distance)
estimate all cosines. The quantisation error of every row is known, and with it the angle between the
row and its code. A query that is near enough to the row is at most that much farther from the code,
so all rows that may reach the wanted cosine are reranked with the exact vectors.

So nothing is lost by quantisation; only a pair that shares no cell (neither lives where the other
lives or visits) is lost. The README has the measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import collect_bounded, materialize

#: Cells that a vector is compared in: its own and the next nearest.
PROBES = 4
#: Collections of fewer vectors are one cell, so nothing is lost in them.
ONE_CELL = 2000
#: A collection of n vectors has (2 n) ** 0.5 cells, at most MAX_CELLS. The sample that is fitted has
#: SAMPLE vectors a cell, so 20 * 8192 rows at most.
MAX_CELLS, SAMPLE, ROUNDS = 8192, 20, 6
#: Subspaces and code words of the product quantiser.
PARTS, WORDS = 8, 256
#: Rows of a cell compared in one group; larger cells are cut into blocks, compared block by block.
BLOCK = 4096
#: Queries whose tables are held at once.
TILE = 512
#: Trained (collection, length) pairs; more are refused, as each has its own cells on the driver.
MAX_TRAINED = 1000


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest element first, so that no square over- or underflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def train_cells(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit centroids of the rows of ``sample``; the same for the same rows."""
    x = _units(sample).astype(np.float32)
    rng = np.random.default_rng(k)
    cells = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS if k > 1 else 1):
        home = (x @ cells.T).argmax(1)
        total = np.zeros(cells.shape, np.float64)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        cells = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], cells).astype(np.float32)
    return cells


def _nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (words * words).sum(1) / 2
    for i in range(0, len(x), 65536):
        out[i : i + 65536] = (x[i : i + 65536] @ words.T - half).argmax(1)
    return out


class Quantiser:
    """Cells and the product code words of the residuals to them."""

    def __init__(self, sample: np.ndarray, cells: int, rows: int = 0):
        self.rows = rows or len(sample)
        self.cells = train_cells(sample, cells)
        x = _units(sample).astype(np.float32)
        home = (x @ self.cells.T).argmax(1)
        rest = x - self.cells[home]
        self.share = np.bincount(home, minlength=len(self.cells)) / max(1, len(x))
        self.parts = [p for p in np.array_split(np.arange(x.shape[1]), PARTS) if len(p)]
        self.words = [self._train(rest[:, p]) for p in self.parts]

    @staticmethod
    def _train(x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(len(x))
        words = x[rng.choice(len(x), min(WORDS, len(x)), replace=False)].copy()
        for _ in range(ROUNDS):
            near = _nearest_word(x, words)
            n = np.bincount(near, minlength=len(words))
            total = np.stack([np.bincount(near, x[:, d], len(words)) for d in range(x.shape[1])], 1)
            words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words).astype(np.float32)
        return words

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors) of unit rows ``x``; the error is the length of what the code leaves out."""
        rest = x - self.cells[home]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        left = np.zeros(len(x))
        for m, p in enumerate(self.parts):
            codes[:, m] = _nearest_word(rest[:, p], self.words[m])
            left += ((rest[:, p] - self.words[m][codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left).astype(np.float32)

    def estimate(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Cosines of unit ``queries`` with the coded rows of a cell, by tables of products."""
        out = np.repeat((queries @ self.cells[cell])[:, None], len(codes), axis=1)
        for m, p in enumerate(self.parts):
            out += np.take(queries[:, p] @ self.words[m].T, codes[:, m], axis=1)
        return out

    def least_estimate(self, cell: int, codes: np.ndarray, error: np.ndarray, least: float) -> np.ndarray:
        """What the estimate of a unit query is at least, for each coded row, if their cosine is ``least`` or more.

        The angle of the query to the code is at most its angle to the row and the row's to the code.
        """
        coded = self.cells[cell] + np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)
        size = np.linalg.norm(coded.astype(np.float64), axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = (1 + size**2 - error.astype(np.float64) ** 2) / (2 * size)  # by the law of cosines
        # The thousandth covers single precision where the arc cosine is steepest.
        angle = np.arccos(np.clip(least, -1, 1)) + np.arccos(np.clip(own, -1, 1)) + 1e-3
        return np.where(size > 1e-6, size * np.cos(np.minimum(angle, np.pi)) - 1e-4, -np.inf)


def _place(key: np.ndarray, cos: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The place of each pair among those of its key: by cosine, then by the other row."""
    order = np.lexsort((other, -cos, key))
    place = np.empty(len(key), np.int64)
    sorted_key = key[order]
    start = np.r_[0, np.nonzero(sorted_key[1:] != sorted_key[:-1])[0] + 1]
    place[order] = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
    return place


def close_pairs(quantiser: Quantiser, cell: int, rows: np.ndarray, stored: np.ndarray, asking: np.ndarray, ids: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of pairs of a stored and an asking row that may be among the ``k`` nearest of either."""
    exact = _units(rows)
    fast = exact.astype(np.float32)
    home, ask = np.nonzero(stored)[0], np.nonzero(asking)[0]
    codes, error = quantiser.encode(fast[home], np.full(len(home), cell))
    enough = quantiser.least_estimate(cell, codes, error, least).astype(np.float32)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(ask), TILE):
        q = ask[at : at + TILE]
        i, j = np.nonzero(quantiser.estimate(fast[q], cell, codes) >= enough)
        i, j = q[i], home[j]
        # A pair of two rows that both live and ask here is met twice.
        wanted = (ids[i] != ids[j]) & ((i < j) | ~(stored[i] & asking[j]))
        i, j = i[wanted], j[wanted]
        for b in range(0, len(i), 20_000):  # the exact rerank, of what single precision leaves
            x, y = i[b : b + 20_000], j[b : b + 20_000]
            close = np.einsum("ij,ij->i", fast[x], fast[y]) >= least - 1e-4
            x, y = x[close], y[close]
            cos = np.round(np.einsum("ij,ij->i", exact[x], exact[y]), 9)
            x, y, cos = x[cos >= least], y[cos >= least], cos[cos >= least]
            found.append((x, y, cos))
    i, j, cos = (np.concatenate(x) for x in zip(*found, strict=True))
    both = _place(np.r_[i, j], np.r_[cos, cos], ids[np.r_[j, i]]) < k
    kept = both[: len(i)] | both[len(i) :]
    return i[kept], j[kept], cos[kept]


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(collection, id, vector) of the rows that can have a similarity."""
    usable = vectors.select("collection", "id", "vector").where(F.col("collection").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0))
    return usable.where(F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vector", lambda x: x != 0))


def _fit(usable: DataFrame) -> dict[tuple[str, int], Quantiser]:
    """Quantisers of the collections and lengths with ONE_CELL vectors or more, from a sample by hash."""
    sizes = usable.groupBy("collection", F.size("vector").alias("dim")).count().where(F.col("count") >= ONE_CELL)
    wanted = {(name, dim): (n, min(MAX_CELLS, round((2 * n) ** 0.5))) for name, dim, n in collect_bounded(sizes, MAX_TRAINED)}
    drawn = F.lit(False)
    for (name, dim), (n, cells) in wanted.items():
        least = F.lit(int(min(1.0, SAMPLE * cells / n) * (1 << 20)) + 1)
        drawn |= (F.col("collection") == name) & (F.size("vector") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < least)
    fitted = {}
    if wanted:
        sample = usable.where(drawn).withColumn("dim", F.size("vector")).toArrow().sort_by([("collection", "ascending"), ("dim", "ascending"), ("id", "ascending")])
        for (name, dim), (n, cells) in wanted.items():
            rows = sample.filter((pc.field("collection") == name) & (pc.field("dim") == dim)).column("vector").combine_chunks()
            vectors = np.asarray(rows.flatten(), np.float32).reshape(-1, dim)
            if len(vectors):
                fitted[name, dim] = Quantiser(vectors, min(cells, len(vectors)), n)
    return fitted


def similar_pairs(vectors: DataFrame, least: float, k: int) -> DataFrame:
    """(collection, id_a, id_b, cosine) of pairs of rows of a collection, id_a < id_b.

    ``vectors`` has (collection, id, vector). The cosine is at least ``least`` and one row is among
    the ``k`` most similar of the other, equal cosines (to nine digits) by id. Null and zero vectors
    and vectors with a null or non-finite element have no similarity, nor vectors of different
    lengths; rows with a null id or collection are no rows. Rows repeated under one id are no pair.
    An empty table gives no rows. Stored copies count as rows, but only the first of them is searched;
    the others share its neighbours. Of each group of copies the ``k`` + 1 smallest ids are the only
    ones that can be among the ``k`` nearest of any row, so a group of any size stays small.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors)
    fitted = _fit(usable)
    shared = spark.sparkContext.broadcast(fitted)  # at most MAX_CELLS centroids for each collection

    # Groups of copies: the limit on row_number is applied before the shuffle too, so no task gets
    # more than k + 1 rows of a group from each other task. Two hashes stand for the vector.
    same: list[Column] = [F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2")]
    keyed = usable.select("collection", "id", "vector", *same)
    w = Window.partitionBy("collection", "h1", "h2").orderBy("id")
    first = keyed.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)
    reps = first.groupBy("collection", "h1", "h2").agg(F.min("id").alias("id"), F.min_by("vector", "id").alias("vector"), F.sort_array(F.collect_set("id")).alias("heads"))

    def blocks(quantiser: Quantiser | None, cell: int) -> int:
        return 1 if quantiser is None else max(1, round(1.2 * quantiser.share[cell] * quantiser.rows * PROBES / BLOCK + 0.5))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = np.asarray(batch.column("collection").to_pylist(), object), np.asarray(batch.column("id"))
            lists, heads = batch.column("vector"), batch.column("heads")
            size = np.diff(np.asarray(lists.offsets))
            flat, start = np.asarray(lists.flatten(), np.float32), np.r_[0, np.cumsum(size)]
            for name, dim in {*zip(names.tolist(), size.tolist(), strict=True)}:
                at = np.nonzero((names == name) & (size == dim))[0]
                rows = flat[start[at][:, None] + np.arange(dim)]
                quantiser = shared.value.get((name, dim))
                if quantiser is None:
                    top = np.zeros((len(at), 1), np.int64)
                else:
                    near = _units(rows).astype(np.float32) @ quantiser.cells.T
                    few = min(PROBES, near.shape[1])
                    top = np.argpartition(-near, few - 1, axis=1)[:, :few] if few < near.shape[1] else np.argsort(-near, axis=1)
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                # (row, cell, block of the stored, block of the asking, stored, asking): where each row goes.
                number = {c: blocks(quantiser, c) for c in np.unique(top).tolist()}
                spread = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                goes: list[tuple] = []
                for nth in range(top.shape[1]):
                    count = np.array([number[c] for c in top[:, nth].tolist()], np.int64)
                    own = (spread % count.astype(np.uint64)).astype(np.int64)
                    rowno = np.repeat(np.arange(len(at)), count)
                    other = np.arange(len(rowno)) - np.repeat(np.cumsum(count) - count, count)
                    mine, cell = own[rowno], top[rowno, nth]
                    if nth:
                        goes.append((rowno, cell, other, mine, np.zeros(len(rowno), bool), np.ones(len(rowno), bool)))
                    else:
                        meets = other == mine
                        goes.append((rowno, cell, mine, other, np.ones(len(rowno), bool), meets))
                        goes.append((rowno[~meets], cell[~meets], other[~meets], mine[~meets], np.zeros((~meets).sum(), bool), np.ones((~meets).sum(), bool)))
                rowno, cell, stored_block, asking_block, stored, asking = (np.concatenate(x) for x in zip(*goes, strict=True))
                raw = pa.array([r.tobytes() for r in rows], pa.binary())
                n, take = len(rowno), pa.array(rowno)
                for i in range(0, n, 20_000):
                    s = slice(i, i + 20_000)
                    part = take.slice(i, 20_000)
                    m = len(part)
                    columns = [pa.array([name] * m, pa.string()), pa.array([dim] * m, pa.int32()), *[pa.array(x[s].astype(np.int32), pa.int32()) for x in (cell, stored_block, asking_block)], pa.array(ids[at][rowno[s]], pa.int64()), raw.take(part), heads.take(pa.array(at[rowno[s]])).cast(pa.list_(pa.int64())), pa.array(stored[s]), pa.array(asking[s])]
                    yield pa.RecordBatch.from_arrays(columns, names=["collection", "dim", "cell", "stored_block", "asking_block", "id", "raw", "heads", "stored", "asking"])

    def compare(group: pa.Table) -> pa.Table:
        name, dim, cell = (group.column(c)[0].as_py() for c in ("collection", "dim", "cell"))
        rows = np.frombuffer(b"".join(group.column("raw").to_pylist()), np.float32).reshape(group.num_rows, -1)
        ids = np.asarray(group.column("id"))
        quantiser = shared.value.get((name, dim)) or Quantiser(rows, 1)  # fewer than ONE_CELL rows: all of them
        i, j, cos = close_pairs(quantiser, cell, rows, np.asarray(group.column("stored")), np.asarray(group.column("asking")), ids, least, k)
        heads = group.column("heads").combine_chunks()
        i, j, cos = np.r_[i, j], np.r_[j, i], np.r_[cos, cos]
        columns = [pa.array([name] * len(i), pa.string()), heads.take(pa.array(i)), heads.take(pa.array(j)), pa.array(cos, pa.float64())]
        return pa.Table.from_arrays(columns, names=["collection", "of", "near", "cosine"]).cast(edge)

    edge = pa.schema([("collection", pa.string()), ("of", pa.list_(pa.int64())), ("near", pa.list_(pa.int64())), ("cosine", pa.float64())])
    placed_type = "collection string, dim int, cell int, stored_block int, asking_block int, id bigint, raw binary, heads array<bigint>, stored boolean, asking boolean"
    placed = reps.select("collection", "id", "vector", "heads").mapInArrow(assign, placed_type)
    met = placed.groupBy("collection", "dim", "cell", "stored_block", "asking_block").applyInArrow(compare, "collection string, of array<bigint>, near array<bigint>, cosine double")
    # The copies of a row are neighbours of each other.
    alike = reps.where(F.size("heads") > 1).select("collection", F.col("heads").alias("of"), F.col("heads").alias("near"), F.lit(1.0).alias("cosine"))
    sides = met.unionByName(alike).select("collection", F.explode("of").alias("row"), "near", "cosine").select("collection", "row", "cosine", F.explode("near").alias("other"))
    sides = sides.where(F.col("row") != F.col("other")).groupBy("collection", "row", "other").agg(F.max("cosine").alias("cosine"))
    nearest = Window.partitionBy("collection", "row").orderBy(F.desc("cosine"), "other")
    near = sides.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).select("collection", "row", "other", "cosine")
    # Used twice below. Whether two users share a shuffle depends on when the planner meets them, and
    # without that the cells would be compared twice.
    near = materialize(near)
    # A copy beyond the first k + 1 has the neighbours of the last of these: that one has k smaller
    # copies, so it is no neighbour of either. Only such large groups are joined, and a hot one has
    # its rows split by the adaptive skew join.
    last = reps.where(F.size("heads") == k + 1).select("collection", "h1", "h2", F.col("heads")[k].alias("row"))
    shown = near.join(last, ["collection", "row"]).groupBy("collection", "h1", "h2", "row").agg(F.collect_list(F.struct("other", "cosine")).alias("near"))
    beyond = keyed.select("collection", "id", "h1", "h2").join(shown, ["collection", "h1", "h2"]).where(F.col("id") > F.col("row"))
    more = beyond.select("collection", F.col("id").alias("row"), F.explode("near").alias("e")).select("collection", "row", "e.other", "e.cosine")
    near = near.unionByName(more)
    return near.select("collection", F.least("row", "other").alias("id_a"), F.greatest("row", "other").alias("id_b"), "cosine").distinct()
