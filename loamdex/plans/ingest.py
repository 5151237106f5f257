"""Scanning: discover files, skip those that are unchanged, parse, chunk, embed, and publish a new version."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loamdex.chunkers.operators import chunked
from loamdex.embed.embedders import Embedder
from loamdex.embed.operators import with_vectors
from loamdex.operators.metadata import classified, removed, stale_on_disk, upserted
from loamdex.parsers.registry import parsed
from loamdex.session import materialize
from loamdex.sources.filesystem import FilesystemSource, ScanOptions, Source, with_content
from loamdex.store import Index


@dataclass
class ScanStats:
    discovered: int = 0
    skipped: int = 0
    indexed: int = 0
    chunks: int = 0
    errors: int = 0
    cache_hits: int = 0
    file_types: dict[str, int] = field(default_factory=dict)
    failures: list[tuple[str, str]] = field(default_factory=list)


#: Failed files that are named in the result of a scan.
NAMED_FAILURES = 100


def scan(spark: SparkSession, index: Index, options: ScanOptions, embedder: Embedder | None = None, chunk_size: int = 512, chunk_overlap: int = 64, source: Source | None = None) -> ScanStats:
    """Bring the index up to date with the files below the given paths.

    A file whose content_hash is that of the index is skipped; the rows of a changed one are replaced. One
    that can't be read counts as an error and is tried again next time, its old rows kept; one without text
    is recorded with no chunks. Files that are gone stay until :func:`prune`. A dry run only counts what is
    discovered. The new version is published in one step, so a run that is stopped changes nothing.
    """
    source = source or FilesystemSource()
    items = source.discover(spark, options)
    if options.dry_run:
        return ScanStats(discovered=items.count())
    with index.lock():
        items = materialize(items)
        states = materialize(classified(items, index.table("sources")))
        stats = ScanStats(discovered=items.count())
        due = states.where(F.col("state") != "same").drop("state")
        stats.skipped = stats.discovered - due.count()
        if stats.skipped == stats.discovered:
            return stats
        documents = materialize(parsed(with_content(due)).withColumn("file_type", F.coalesce("extension", F.lit("unknown"))))
        good = documents.where(F.col("error").isNull())
        failed = documents.where(F.col("error").isNotNull()).select("uri", "error")
        stats.failures = [tuple(r) for r in failed.orderBy("uri").limit(NAMED_FAILURES).collect()]
        cut = chunked(good.select("uri", "text", "content_type", "file_type", "title", "language"), chunk_size, chunk_overlap)
        cut = materialize(cut)
        chunks, cache = with_vectors(cut, embedder, index.table("cache") if embedder else None)
        chunks = materialize(chunks)
        counts = chunks.groupBy("uri").agg(F.count("*").cast("int").alias("chunk_count"))
        rows = good.select("uri", "content_hash", F.col("size").alias("file_size"), "file_type", "modified_at", F.lit(int(time.time())).alias("indexed_at"), F.lit("indexed").alias("status"))
        rows = materialize(rows.join(counts, "uri", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))))
        tables = {"sources": upserted(index.table("sources"), rows), "chunks": index.table("chunks").join(rows.select("uri"), "uri", "left_anti").unionByName(chunks)}
        if embedder:
            before = index.table("cache").where(F.col("model") == embedder.name).count()
            tables["cache"] = cache = materialize(cache)
            texts = chunks.select("text").distinct().count()
            stats.cache_hits = texts - (cache.where(F.col("model") == embedder.name).count() - before)
        index.commit(**tables)
        stats.errors = failed.count()
        stats.chunks = chunks.count()
        stats.file_types = {r[0]: r[1] for r in rows.groupBy("file_type").count().collect()}
        stats.indexed = sum(stats.file_types.values())
        return stats


def remove(index: Index, uri: str, prefix: bool = False) -> int:
    """Take a file out of the index, by path or uri; with ``prefix`` everything below it. How many files that were."""
    uri = uri if "://" in uri else f"file://{uri}"
    with index.lock():
        sources = index.table("sources")
        gone = index.spark.createDataFrame([(uri,)], "uri string")
        left = removed(sources, gone, prefix)
        n = sources.count() - left.count()
        if n:
            index.commit(sources=left, chunks=index.table("chunks").join(left.select("uri"), "uri", "left_semi"))
        return n


def prune(index: Index) -> int:
    """Take files that are gone from the disk out of the index. How many that were."""
    with index.lock():
        sources = index.table("sources")
        gone = materialize(stale_on_disk(sources).select("uri"))
        n = gone.count()
        if n:
            index.commit(sources=sources.join(gone, "uri", "left_anti"), chunks=index.table("chunks").join(gone, "uri", "left_anti"))
        return n
