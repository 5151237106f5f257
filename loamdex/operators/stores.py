"""What a store of chunks can do, and the store that is a table.

Anything with these methods can stand in for the built-in engines. A :class:`ChunkTable` never changes:
inserting and deleting give a new one, and statistics such as lengths and frequencies follow from its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators.hybrid import search as hybrid_search
from loamdex.operators.keyword import bm25_search
from loamdex.operators.vector import vector_search


class KeywordStore(Protocol):
    """Finds chunks by words."""

    def insert(self, rows: DataFrame) -> KeywordStore: ...

    def delete(self, uri: str) -> tuple[KeywordStore, int]: ...

    def search(self, query: str, k: int) -> DataFrame: ...


class VectorStore(Protocol):
    """Finds chunks by vectors."""

    def insert(self, rows: DataFrame) -> VectorStore: ...

    def delete(self, uri: str) -> tuple[VectorStore, int]: ...

    def near(self, vector: Sequence[float], k: int) -> DataFrame: ...

    def count(self) -> int: ...


class ChunkTable:
    """A table of chunks as a store of both kinds; one change serves both, so they can't disagree."""

    def __init__(self, rows: DataFrame, keyword: Callable[[DataFrame, str, int], DataFrame] = bm25_search):
        self.rows, self.keyword = rows, keyword

    @classmethod
    def load(cls, spark: SparkSession, path: str, keyword: Callable[[DataFrame, str, int], DataFrame] = bm25_search) -> ChunkTable:
        return cls(spark.read.parquet(path), keyword)

    def save(self, path: str) -> None:
        self.rows.write.parquet(path)

    def insert(self, rows: DataFrame) -> ChunkTable:
        """Appended as they are: a chunk inserted twice is there twice."""
        return ChunkTable(self.rows.unionByName(rows, allowMissingColumns=True), self.keyword)

    def delete(self, uri: str) -> tuple[ChunkTable, int]:
        """Without the chunks of a file, and how many these were."""
        gone = F.col("uri") == uri
        return ChunkTable(self.rows.where(~F.coalesce(gone, F.lit(False))), self.keyword), self.rows.where(gone).count()

    def count(self) -> int:
        return self.rows.count()

    def search(self, query: str, k: int = 10) -> DataFrame:
        return self.keyword(self.rows, query, k)

    def near(self, vector: Sequence[float], k: int = 10) -> DataFrame:
        return vector_search(self.rows, vector, k)

    def both(self, query: str, vector: Sequence[float] | None, k: int = 10, mode: str = "hybrid", alpha: float | None = None) -> DataFrame:
        return hybrid_search(self.rows, query, vector, k, mode, alpha, self.keyword)

    def push(self, query: str, k: int, sink: Callable[[dict], bool]) -> int:
        """Hand hits to ``sink`` in their order until it returns False; how many it got."""
        taken = 0
        for row in self.search(query, k).toLocalIterator():
            taken += 1
            if not sink(row.asDict(recursive=True)):
                break
        return taken

    def export(self) -> Iterator[dict]:
        for row in self.rows.toLocalIterator():
            yield row.asDict(recursive=True)
