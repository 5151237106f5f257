"""Keyword and vector results as one ranking, and the modes of search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators.keyword import bm25_search
from loamdex.operators.vector import vector_search

#: Constant of reciprocal rank fusion, and the weight of the vector side where none is given.
RANK_OFFSET, DEFAULT_ALPHA = 60, 0.7
MODES = ("hybrid", "vector_only", "keyword_only")
KEYS = ("uri", "chunk_index")


def clamped(alpha: float | None) -> float:
    return DEFAULT_ALPHA if alpha is None else min(1.0, max(0.0, alpha))


def _share(hits: DataFrame, weight: Column | float, by: Sequence[str]) -> DataFrame:
    """The weight over (offset + rank) of each hit; a key listed twice is paid twice, its first row is its payload."""
    over = Window.partitionBy(*by) if by else Window.partitionBy()
    ranked = hits.withColumn("_rank", F.row_number().over(over.orderBy(F.desc("score"), *KEYS)))
    rest = [c for c in hits.columns if c not in (*KEYS, *by, "score")]
    first = [F.min_by(c, "_rank").alias(c) for c in rest]
    return ranked.groupBy(*by, *KEYS).agg(F.sum(F.lit(weight) / (RANK_OFFSET + F.col("_rank"))).alias("_part"), *first)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float | None, k: int | None) -> DataFrame:
    """Weighted reciprocal rank fusion of two bounded hit lists, by (uri, chunk_index).

    The score is alpha / (60 + rank) of the vector list plus (1 - alpha) / (60 + rank) of the keyword
    list, ranks from 1. Where both have a chunk its other columns are the vector side's. Equal scores
    (to twelve digits) go by uri and chunk_index.
    """
    a = clamped(alpha)
    left, right = _share(vector_hits, a, ()), _share(keyword_hits, 1 - a, ())
    rest = [c for c in left.columns if c not in (*KEYS, "_part")]
    joined = left.alias("v").join(right.alias("w"), [F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")) for c in KEYS], "full_outer")
    here = F.col("v._part").isNotNull()
    picked = [F.when(here, F.col(f"v.{c}")).otherwise(F.col(f"w.{c}")).alias(c) for c in (*KEYS, *rest) if c in right.columns]
    score = F.round(F.coalesce("v._part", F.lit(0.0)) + F.coalesce("w._part", F.lit(0.0)), 12)
    out = joined.select(*picked, score.alias("score")).orderBy(F.desc("score"), *KEYS)
    return out if k is None else out.limit(k)


def search(chunks: DataFrame, text: str, vector: Sequence[float] | None, k: int = 10, mode: str = "hybrid", alpha: float | None = None, keyword=bm25_search) -> DataFrame:
    """The ``k`` best chunks by one of MODES; hybrid fuses the best 3 k of each side.

    Without a query vector hybrid and vector_only fall back to keywords.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    slim = chunks.drop("vector")
    if mode == "keyword_only" or vector is None:
        return keyword(slim, text, k)
    if mode == "vector_only":
        return vector_search(chunks, vector, k).drop("vector")
    return fuse(vector_search(chunks, vector, 3 * k).drop("vector"), keyword(slim, text, 3 * k), alpha, k)
