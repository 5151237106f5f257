"""The table of indexed files, one row a uri: (uri, content_hash, file_size, file_type, modified_at, indexed_at, chunk_count, status).

A change of the table is a new one; the store publishes it as a snapshot.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIVE = "indexed"


def current_sources(history: DataFrame) -> DataFrame:
    """The last row of each uri, by (indexed_at, source_id); of a table that was appended to."""
    order = [c for c in ("indexed_at", "source_id") if c in history.columns]
    w = Window.partitionBy("uri").orderBy(*[F.desc(c) for c in order])
    return history.where(F.col("uri").isNotNull()).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def living(sources: DataFrame) -> DataFrame:
    return sources.where(F.coalesce("status", F.lit(LIVE)) != "deleted")


def index_stats(sources: DataFrame) -> DataFrame:
    """(file_type, files, chunks): files and chunks of each type, and of all with a null type and ``whole`` true."""
    grouped = sources.select(F.coalesce("file_type", F.lit("unknown")).alias("file_type"), "chunk_count").rollup("file_type")
    return grouped.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("chunks"), F.grouping("file_type").cast("boolean").alias("whole"))


def totals(sources: DataFrame) -> DataFrame:
    """One row: total_sources, total_chunks and the map file_type_counts."""
    types = sources.groupBy(F.coalesce("file_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("c"))
    # A row a file type, which are few.
    return types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_sources"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_chunks"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "n")))).alias("file_type_counts"))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("uri")


def modified_since(sources: DataFrame, since: int) -> DataFrame:
    """(uri) of files modified at ``since`` or later; a null time never matches."""
    return sources.where(F.col("modified_at") >= since).select("uri").distinct()


def classified(items: DataFrame, sources: DataFrame) -> DataFrame:
    """``items`` plus ``state``: new, same or changed, by content_hash against the indexed files."""
    known = sources.select("uri", F.col("content_hash").alias("_old"), F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("content_hash")), "same").otherwise("changed")
    return items.join(known, "uri", "left").withColumn("state", state).drop("_old", "_known")


def upserted(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """``sources`` with ``rows`` in place of those of the same uri; of several rows of a uri the last indexed_at."""
    w = Window.partitionBy("uri").orderBy(F.desc("indexed_at"), *[F.desc(c) for c in ("source_id",) if c in rows.columns])
    last = rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")
    return sources.join(last.select("uri"), "uri", "left_anti").unionByName(last, allowMissingColumns=True)


def removed(sources: DataFrame, uris: DataFrame, prefix: bool = False) -> DataFrame:
    """``sources`` without the given uris, or with ``prefix`` without everything below them."""
    if not prefix:
        return sources.join(uris.select("uri").distinct(), "uri", "left_anti")
    # All directories above a file are its keys, so this is an equi-join too.
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("uri", "/"))), lambda i: F.array_join(F.slice(F.split("uri", "/"), F.lit(1), i), "/"))
    gone = sources.select("uri", F.explode(steps).alias("step")).join(uris.select(F.regexp_replace("uri", "/+$", "").alias("step")).distinct(), "step", "left_semi")
    return sources.join(gone.select("uri").distinct(), "uri", "left_anti")


def stale(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Indexed files with a file:// uri that discovery no longer finds; other schemes are never stale."""
    return sources.where(F.col("uri").startswith("file://")).join(items.select("uri"), "uri", "left_anti")


def stale_on_disk(sources: DataFrame) -> DataFrame:
    """The same by looking at the disk of each worker, for indexes of one machine or a shared mount."""

    def missing(batches):
        for batch in batches:
            gone = [u.startswith("file://") and not os.path.exists(u[7:]) for u in batch.column("uri").to_pylist()]
            yield batch.take(pa.array([i for i, g in enumerate(gone) if g], pa.int64()))

    return sources.where(F.col("uri").isNotNull()).mapInArrow(missing, sources.schema)


def parent_directories(sources: DataFrame) -> DataFrame:
    """(directory) of the indexed files, each once, sorted."""
    path = F.regexp_replace("uri", "^file://", "")
    return sources.select(F.regexp_replace(path, "/[^/]*$", "").alias("directory")).where(F.col("directory") != path).distinct().orderBy("directory")


def with_setting(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The key/value table with one key set."""
    row = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta.where(F.col("key") != key).unionByName(row)


def setting(meta: DataFrame, key: str) -> str | None:
    rows = meta.where(F.col("key") == key).select("value").head(1)
    return rows[0][0] if rows else None
