"""Vectors for a table of chunks, with a cache of what was embedded before.

The cache is a table (hash, model, vector): ``hash`` is the SHA-256 of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.embed.embedders import BATCH, Embedder
from loamdex.functions.vector import zeros
from loamdex.session import with_fields


def text_hash(text: str | Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def embedded(texts: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """``texts`` plus ``vector``; a batch that the model fails on gets zero vectors, as a null text does."""
    kept = texts.drop("vector")
    at, schema = kept.columns.index(text), with_fields(kept.schema, "vector array<float>")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            out = np.zeros((len(values), embedder.dimensions), np.float32)
            for i in range(0, len(values), BATCH):
                there = [j for j in range(i, min(i + BATCH, len(values))) if values[j] is not None]
                try:
                    if there:
                        out[there] = embedder.embed_batch([values[j] for j in there])
                except Exception:  # the scan goes on, and the chunk can still be found by its words
                    out[there] = 0
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), embedder.dimensions).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, "vector"])

    return kept.mapInArrow(embed, schema)


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with ``entries`` (hash, model, vector) in place of those of the same hash."""
    return cache.join(entries.select("hash"), "hash", "left_anti").unionByName(entries.dropDuplicates(["hash"]))


def looked_up(chunks: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """``chunks`` (with ``text_hash``) plus ``vector`` and ``cached``; of several entries of a hash the last that has a vector.

    The entries are reduced to one a hash within tasks before they are joined.
    """
    usable = cache.where(F.col("vector").isNotNull() & F.col("hash").isNotNull())
    if model is not None:
        usable = usable.where(F.col("model") == model)
    order = F.struct(*[c for c in ("created_at", "vector") if c in cache.columns])
    one = usable.groupBy(F.col("hash").alias("text_hash")).agg(F.max_by("vector", order).alias("vector"))
    return chunks.drop("vector").join(one, "text_hash", "left").withColumn("cached", F.col("vector").isNotNull())


def cache_stats(cache: DataFrame) -> DataFrame:
    """(model, entries, hashes, bytes)."""
    size = F.octet_length("vector") if dict(cache.dtypes)["vector"] == "binary" else 4 * F.size("vector")
    return cache.groupBy("model").agg(F.count("*").alias("entries"), F.countDistinct("hash").alias("hashes"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def with_vectors(chunks: DataFrame, embedder: Embedder | None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks with vectors, cache with the new ones): each distinct text that isn't cached is embedded once.

    Without an embedder every vector is zeros, as is that of a null text.
    """
    if embedder is None:
        return chunks.drop("vector").withColumn("vector", zeros()), cache
    hashed = chunks.drop("vector").withColumn("text_hash", text_hash("text"))
    if cache is None:
        cache = chunks.sparkSession.createDataFrame([], "hash binary, model string, vector array<float>")
    found = looked_up(hashed, cache, embedder.name)
    missing = found.where(~F.col("cached") & F.col("text_hash").isNotNull()).select("text_hash", "text").dropDuplicates(["text_hash"])
    new = embedded(missing, embedder).select(F.col("text_hash").alias("hash"), F.lit(embedder.name).alias("model"), "vector")
    known = put(cache, new)
    return looked_up(hashed, known, embedder.name).drop("text_hash", "cached").withColumn("vector", F.coalesce("vector", zeros(embedder.dimensions))), known


def with_image_vectors(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Every chunk of an image gets the image's own vector (uri, image_vector), where there is one, in place of its text's."""
    one = images.groupBy("uri").agg(F.first("image_vector", ignorenulls=True).alias("_image"))
    joined = chunks.join(one, "uri", "left")
    vector = F.when(F.col("content_type") == "image", F.coalesce("_image", "vector", zeros())).otherwise(F.coalesce("vector", zeros()))
    return joined.withColumn("vector", vector).drop("_image")
