"""An index opened for searching."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from loamdex.config import Config
from loamdex.embed.embedders import Embedder
from loamdex.embed.models import QUERY_PREFIX
from loamdex.errors import EmbeddingError, SearchError
from loamdex.operators.filters import narrowed
from loamdex.operators.hybrid import search
from loamdex.operators.keyword import bm25_search, fts_search, syntax_search
from loamdex.operators.metadata import totals
from loamdex.store import Index

ENGINES = {"fts": fts_search, "bm25": bm25_search, "syntax": syntax_search}
MODES = {"hybrid": "hybrid", "vector": "vector_only", "keyword": "keyword_only"}


class Engine:
    """Search over an index's chunks, with the keyword engine and weight of its settings."""

    def __init__(self, index: Index, config: Config | None = None, embedder: Embedder | None = None, keyword: str = "fts"):
        if keyword not in ENGINES:
            raise SearchError(f"the keyword engine is one of {', '.join(ENGINES)}")
        self.index, self.config, self.embedder, self.keyword = index, config or Config(), embedder, ENGINES[keyword]

    def vector(self, text: str) -> list[float] | None:
        """A query's vector, None without a model."""
        if self.embedder is None:
            return None
        try:
            return [float(x) for x in self.embedder.embed_batch([QUERY_PREFIX + text])[0]]
        except Exception as e:
            raise EmbeddingError(f"the query can't be embedded: {e}") from e

    def mode(self, wanted: str) -> str:
        """Without a model every search is one by keywords."""
        return "keyword" if self.embedder is None else wanted

    def hits(self, text: str, k: int, mode: str = "hybrid") -> DataFrame:
        """The ``k`` best chunks, in no filter's way."""
        if mode not in MODES:
            raise SearchError(f"the mode is one of {', '.join(MODES)}")
        mode = self.mode(mode)
        vector = None if mode == "keyword" else self.vector(text)
        try:
            return search(self.index.table("chunks"), text, vector, k, MODES[mode], self.config.search.hybrid_alpha, self.keyword)
        except ValueError as e:
            raise SearchError(str(e)) from e

    def search(self, text: str, k: int = 10, mode: str = "hybrid", threshold: float = 0.0, file_type: str | None = None, path: str | None = None, since: int | None = None) -> list[dict]:
        """Rows of the ``k`` best chunks that pass the filters; fewer than k if some don't."""
        found = narrowed(self.hits(text, k, mode), self.index.table("sources"), threshold, file_type, path, since)
        return [r.asDict(recursive=True) for r in found.orderBy(found["score"].desc(), "uri", "chunk_index").collect()]

    def streamed(self, text: str, k: int = 10, mode: str = "hybrid") -> Iterator[dict]:
        """The hits one by one; a consumer may stop early."""
        found = self.hits(text, k, mode)
        for r in found.orderBy(found["score"].desc(), "uri", "chunk_index").toLocalIterator():
            yield r.asDict(recursive=True)

    def status(self) -> dict:
        r = totals(self.index.table("sources")).collect()[0]
        return {"total_sources": r["total_sources"], "total_chunks": r["total_chunks"], "index_size_bytes": self.index.size(), "file_type_counts": r["file_type_counts"]}
