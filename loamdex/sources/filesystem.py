"""Files of a folder, or of a shared mount, as a table.

The driver only lists names, the way a version control tool does; bytes are read, hashed and looked at
by the tasks. For folders of more files than a driver can list, :func:`listed` takes a table of paths.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.session import with_fields
from loamdex.sources.ignore import Overrides, Rules, global_rules
from loamdex.sources.mime import MIME_OF, extension_of, mime_of_name, sniff

ITEM = "uri string, path string, content_hash binary, size bigint, modified_at bigint, mime_type string, extension string"
#: Files read by one task, about.
FILES_A_TASK = 256


@dataclass
class ScanOptions:
    paths: list[str] = field(default_factory=list)
    max_depth: int | None = None
    max_file_size: int | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    file_types: list[str] = field(default_factory=list)
    dry_run: bool = False


class Source(Protocol):
    def discover(self, spark: SparkSession, options: ScanOptions) -> DataFrame:
        """The columns of ITEM."""


def walk(root: str, options: ScanOptions) -> Iterator[tuple[str, int, int]]:
    """(path, size, modified) of the files below a root that no pattern leaves out; a missing root has none.

    Hidden files and folders are left out; so is what .gitignore and .ignore files of the folder, the
    user's own file and a repository's exclude file name. Symbolic links are followed to files only. Depth 1
    are the files of the root itself.
    """
    root = os.path.realpath(root)
    if os.path.isfile(root):
        info = os.stat(root)
        yield root, info.st_size, int(info.st_mtime)
        return
    overrides = Overrides(options.include, options.exclude)
    own = global_rules()
    todo: list[tuple[str, int, list[tuple[str, Rules]]]] = [(root, 1, [(root, own)] if own else [])]
    while todo:
        folder, depth, above = todo.pop()
        if options.max_depth is not None and depth > options.max_depth:
            continue
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        here = [(folder, r) for n in (".git/info/exclude", ".gitignore", ".ignore") if (r := Rules.read(os.path.join(folder, n)))]
        rules = above + here
        for e in entries:
            try:
                is_dir = e.is_dir(follow_symlinks=False)
                if e.name.startswith(".") or overrides.left_out(os.path.relpath(e.path, root), is_dir):
                    continue
                verdicts = (r.verdict(os.path.relpath(e.path, base), is_dir) for base, r in reversed(rules))
                if next((v for v in verdicts if v is not None), False):
                    continue
                if is_dir:
                    todo.append((e.path, depth + 1, rules))
                elif e.is_file():
                    info = e.stat()
                    yield e.path, info.st_size, int(info.st_mtime)
            except OSError:
                continue


def _wanted(path: str, size: int, options: ScanOptions) -> bool:
    """By size, and by type: the extension, or a part of the MIME type of the name."""
    if options.max_file_size is not None and size > options.max_file_size:
        return False
    if not options.file_types:
        return True
    extension = (extension_of(path) or "").lower()
    mime = mime_of_name(path) or ""
    return any(extension == t or (mime and t in mime) for t in options.file_types)


def listed(paths: DataFrame) -> DataFrame:
    """The columns of ITEM for a table (path, size, modified_at): the tasks read, hash and look at each file.

    A file that is gone or can't be read has no row, nor has one with neither a known type nor an extension.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, modified in zip(batch.column("path").to_pylist(), batch.column("modified_at").to_pylist(), strict=True):
                try:
                    with open(path, "rb") as f:
                        digest, head, size = hashlib.sha256(), b"", 0
                        while part := f.read(1 << 20):
                            head = head or part[:4096]
                            digest.update(part)
                            size += len(part)
                except OSError:
                    continue
                extension = extension_of(path)
                mime = sniff(head) or mime_of_name(path)
                if mime or extension:
                    rows.append((f"file://{path}", path, digest.digest(), size, modified, mime, extension and extension.lower()))
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in ITEM.split(", ")])

    return paths.select("path", "size", "modified_at").mapInArrow(look, ITEM)


class FilesystemSource:
    """Files below the given paths."""

    def discover(self, spark: SparkSession, options: ScanOptions) -> DataFrame:
        found = {p: (s, m) for root in options.paths for p, s, m in walk(root, options) if _wanted(p, s, options)}
        rows = [(p, s, m) for p, (s, m) in found.items()]
        paths = spark.createDataFrame(rows, "path string, size bigint, modified_at bigint")
        return listed(paths.repartition(max(1, min(len(rows), max(spark.sparkContext.defaultParallelism, len(rows) // FILES_A_TASK)))))


def with_content(items: DataFrame) -> DataFrame:
    """``items`` plus ``content``, read by the tasks; null where a file is gone since it was found."""
    schema = with_fields(items.schema, "content binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):  # one file at a time
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                except OSError:
                    raw = None
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([raw], pa.binary())], names=[*batch.schema.names, "content"])

    return items.mapInArrow(read, schema)


def mime_column(path: str = "path") -> Column:
    """The MIME type by a path's extension as a column expression."""
    table = F.create_map(*[F.lit(x) for pair in MIME_OF.items() for x in pair])
    return table[F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)]
