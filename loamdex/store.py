"""An index on disk: versioned snapshots of its tables, and a pointer to the current one.

``v=<n>/sources``, ``v=<n>/chunks`` (with their vectors) and ``v=<n>/cache`` are Parquet folders. A new
version is written beside the old one and becomes current when the one-line file CURRENT is replaced; a
run that fails before leaves the old version as it was.
"""

from __future__ import annotations

import fcntl
import os
import re
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loamdex.errors import StorageError

SOURCES = "uri string, content_hash binary, file_size bigint, file_type string, modified_at bigint, indexed_at bigint, chunk_count int, status string"
CHUNKS = "uri string, chunk_index int, text string, content_type string, file_type string, title string, language string, byte_range struct<start_off: bigint, end_off: bigint>, vector array<float>"
CACHE = "hash binary, model string, vector array<float>"
TABLES = {"sources": SOURCES, "chunks": CHUNKS, "cache": CACHE}
#: Versions kept for readers that still use them.
KEPT = 2


class Index:
    """The tables of one index folder."""

    def __init__(self, spark: SparkSession, folder: str | os.PathLike):
        self.spark, self.folder = spark, Path(folder)

    @property
    def version(self) -> int | None:
        pointer = self.folder / "CURRENT"
        if not pointer.is_file():
            return None
        m = re.fullmatch(r"v=(\d+)\n?", pointer.read_text())
        if not m:
            raise StorageError(f"{pointer} names no version")
        return int(m[1])

    def exists(self) -> bool:
        return self.version is not None

    def table(self, name: str) -> DataFrame:
        """A table of the current version; empty where there is no index."""
        version = self.version
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        path = self.folder / f"v={version}" / name
        if not path.is_dir():
            raise StorageError(f"the index is damaged: {path} is missing")
        try:
            return self.spark.read.schema(TABLES[name]).parquet(str(path))
        except Exception as e:
            raise StorageError(f"the index is damaged: {path}: {e}") from e

    def commit(self, **tables: DataFrame) -> int:
        """Write a new version of the given tables, take the others along, and make it current."""
        old = self.version
        new = max([old or 0, *(int(p.name[2:]) for p in self.folder.glob("v=*") if p.name[2:].isdigit())], default=0) + 1
        base = self.folder / f"v={new}"
        try:
            for name in TABLES:
                if name in tables or old is None:
                    source = tables.get(name, self.table(name))
                    source.select(*[x.name for x in self.spark.createDataFrame([], TABLES[name]).schema]).write.parquet(str(base / name))
                else:
                    # Files of a version never change, so they can be shared.
                    shutil.copytree(self.folder / f"v={old}" / name, base / name, copy_function=os.link)
        except BaseException:
            shutil.rmtree(base, ignore_errors=True)
            raise
        part = self.folder / f"CURRENT.{os.getpid()}.part"
        part.write_text(f"v={new}\n")
        os.replace(part, self.folder / "CURRENT")
        for p in self.folder.glob("v=*"):
            if p.name[2:].isdigit() and int(p.name[2:]) <= new - KEPT:
                shutil.rmtree(p, ignore_errors=True)
        return new

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Only one writer at a time."""
        self.folder.mkdir(parents=True, exist_ok=True)
        with open(self.folder / ".lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise StorageError("another scan is writing to this index") from e
            yield

    def size(self) -> int:
        """Bytes of the index on disk."""
        return sum(p.stat().st_size for p in self.folder.rglob("*") if p.is_file())
