"""Code files that nobody wrote by hand for a collection: generated, minified, vendored or data.

Method: Merkle hashes are computed bottom-up over the directory trees of all files; a subtree that
unrelated collections share was written for neither and marks vendored code. Header and layout rules
catch the rest: whole path segments and name endings, statements in the leading comment, and the
shape of the text (long dense lines, literals, a counter that runs through the file).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import materialize, scratch_dir

VENDORED_PATH = re.compile(r"/(_?vendor|vendored|node_modules|bower_components|(third|3rd)[-_]?party|externals?|extern|deps|pods|site-packages|\.?venv)/", re.I)
GENERATED_PATH = re.compile(r"/(__generated__|generated|generated-sources|autogen|gen|dist|obj|target)/|(_gen|\.gen|\.generated|_generated|[._]pb|_pb2|_pb2_grpc|\.g)\.\w+$", re.I)
MINIFIED_PATH = re.compile(r"([.-]min|\.bundle)\.\w+$", re.I)

BY_HAND = re.compile(r"(written|maintained|edited) by hand|hand[- ]?written", re.I)
GENERATED = re.compile(r"@generated|auto-?_?generated|generated (automatically |on |by |from |file|code|at )|(code|file|was|is) generated|do not (edit|modify)|(changes|edits) (will|get) |produced by the \S+ build|output of \S+: rerun|don'?t touch this|machine[- ]made|edit the template|(automatisch|maschinell) (erzeugt|generiert)|nicht (bearbeiten|ändern)|généré automatiquement|ne pas modifier|generado automáticamente|no (editar|modificar)|自動生成", re.I)
VENDORED = re.compile(r"vendored|copied (\w+ )?from|imported unchanged|(local|bundled|verbatim|third[- ]party) (copy|snapshot)|patch upstream|upstream (revision|version|commit|release)", re.I)

#: Subtrees with less text than this are shared by chance (blank files, one-line stubs).
LEAST_SHARED = 64
#: A collection with more of its text than this in shared subtrees is a mirror or fork of another, so
#: it is no witness of what is vendored.
MIRROR_SHARE = 0.5

_COMMENT = re.compile(r"\s*(//|#(?!include|pragma|define|if|!)|/\*|\*|--|<!--|;|%|\"\"\"|''')")
_LITERAL = re.compile(r"[A-Za-z0-9+/=]{40,}|0x[0-9a-fA-F]+|-?\b\d+(?:\.\d+)?\b|\\x[0-9a-fA-F]{2}|\s*,\s*")
_NUMBER = re.compile(r"(?<![\d.])\d{1,6}(?![\d.])")
#: Characters in a line from which, on average, no person lays out code; least share of white space.
LONG_LINES, SPACE_SHARE = 200, 0.08
#: Share of the characters in literals that makes a file data.
DATA_SHARE = 0.6
#: A counter that reaches this, and one step for so many lines, is a generator's.
LEAST_STEPS, LINES_PER_STEP = 4, 15


def leading_comment(text: str) -> str:
    """The comment lines before the first line of code."""
    out, inside = [], False
    for line in text.lstrip("﻿").split("\n")[:40]:
        if inside or _COMMENT.match(line):
            out.append(line)
            inside = "*/" not in line if inside or line.lstrip().startswith("/*") else False
        elif line.strip() and not line.startswith("#!"):
            break
    return "\n".join(out)


def counted_steps(text: str) -> int:
    """How far 0, 1, 2, ... goes through the whole numbers of a text, in their order."""
    step = 0
    for x in _NUMBER.findall(text):
        step += int(x) == step
    return step


def kind_of(uri: str | None, text: str | None) -> str | None:
    """vendored, generated, minified, data, or None for a file written by hand or a blank one."""
    body = (text or "").strip("﻿ \t\r\n\f\v\0")
    if not body:
        return None
    path = uri or ""
    if VENDORED_PATH.search(path):
        return "vendored"
    lines = [x for x in body.splitlines() if x.strip()]
    if not lines:
        return None
    head = leading_comment(body)
    if VENDORED.search(head):
        return "vendored"
    if sum(len(m) for m in _LITERAL.findall(body)) >= DATA_SHARE * len(body):
        return "data"
    space = sum(map(str.isspace, body)) / len(body)
    if MINIFIED_PATH.search(path) or (len(body) > LONG_LINES and space < SPACE_SHARE and len(body) / len(lines) > 60) or len(body) / len(lines) > LONG_LINES:
        return "minified"
    if GENERATED_PATH.search(path) or (GENERATED.search(head) and not BY_HAND.search(head)):
        return "generated"
    return "generated" if counted_steps(body) > max(LEAST_STEPS, len(lines) / LINES_PER_STEP) else None


def merkle_nodes(files: DataFrame) -> DataFrame:
    """(path, collection, h1, h2, size) of every file and directory above one.

    ``files`` has (path, collection, h1, h2, size), all numbers but the path, one row a path. A directory's hash is that of the
    set of its children, each by name and hash; the children are combined by exclusive or of two
    hashes, so a directory of any number of files is reduced within partitions first and no task
    holds its children. One level of the trees at a time, from the deepest up, each one written to
    the shared folder: the levels above would compute it again otherwise. A directory is the least
    collection's of its files, and of no use as a witness once it holds two.
    """
    spark = files.sparkSession
    deep = files.withColumn("depth", F.size(F.split("path", "/")))
    deepest = deep.agg(F.max("depth")).collect()[0][0] or 0
    columns = ["path", "collection", "h1", "h2", "size"]
    above, written, folder = None, [], scratch_dir(spark)
    for depth in range(deepest, 0, -1):
        here = deep.where(F.col("depth") == depth).select(*columns)
        written.append(f"{folder}/{depth}")
        (here if above is None else here.unionByName(above)).write.parquet(written[-1])
        name = F.substring_index("path", "/", -1)
        above = (
            spark.read.parquet(written[-1])
            .where(F.length("path") > F.length(name) + 1)
            .select(F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("path"), "collection", F.xxhash64(name, "h1", "h2").alias("c1"), F.xxhash64(F.lit(1), name, "h2", "h1").alias("c2"), "size")
            .groupBy("path")
            .agg(F.min("collection").alias("collection"), F.bit_xor("c1").alias("h1"), F.bit_xor("c2").alias("h2"), F.sum("size").alias("size"))
        )
    return spark.read.parquet(*written) if written else files.select(*columns)


def shared_files(documents: DataFrame) -> DataFrame:
    """(uri) of the files that lie in a subtree which unrelated collections share.

    The collection is ``source`` or, where that is null, the path segment after ``repos``; a file
    with neither is no witness. A file of several rows is one file. Line ends and a byte
    order mark make no difference. Blank files hold no text; subtrees of less than LEAST_SHARED
    characters are not compared.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^\ufeff|\r(?=\n)", "")
    size = F.length(F.regexp_replace(text, r"(?U)[\s\x00]+", ""))
    repo = F.regexp_extract("uri", "/repos/([^/]+)/", 1)
    held = F.coalesce("source", F.when(repo != "", repo))
    collection = F.when(held.isNotNull(), F.xxhash64(held))
    rows = documents.where(F.col("uri").isNotNull()).select("uri", collection.alias("collection"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), size.cast("bigint").alias("size"))
    # Numbers only, as those are aggregated by hash. A path of several texts has the least of each hash.
    files = rows.groupBy(F.col("uri").alias("path")).agg(F.min("collection").alias("collection"), F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.max("size").alias("size"))
    files = materialize(files)
    nodes = merkle_nodes(files)
    same = nodes.where((F.col("size") >= LEAST_SHARED) & F.col("collection").isNotNull()).select("path", "collection", "h1", "h2")

    def held_by_two(those: DataFrame) -> DataFrame:
        return those.groupBy("h1", "h2").agg(F.min("collection").alias("a"), F.max("collection").alias("b")).where(F.col("a") != F.col("b")).select("h1", "h2")

    def inside(shared: DataFrame) -> DataFrame:
        """The files at or below a shared node: a semi join of their path's beginnings with those nodes."""
        above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
        steps = files.withColumn("parts", F.split("path", "/")).select("path", "collection", "size", F.explode(above).alias("step"))
        return steps.join(shared.select(F.col("path").alias("step")), "step", "left_semi").select("path", "collection", "size").distinct()

    found = materialize(same.join(held_by_two(same), ["h1", "h2"], "left_semi"))
    total = files.groupBy("collection").agg(F.sum("size").alias("all"))
    mirrors = inside(found).groupBy("collection").agg(F.sum("size").alias("part")).join(total, "collection").where(F.col("part") > MIRROR_SHARE * F.col("all")).select("collection")
    witnesses = found.join(mirrors, "collection", "left_anti")
    kept = witnesses.join(held_by_two(witnesses), ["h1", "h2"], "left_semi")
    return inside(kept).where(F.col("size") > 0).select(F.col("path").alias("uri"))


def not_by_hand(documents: DataFrame) -> DataFrame:
    """(uri, kind) of the code files of ``documents`` that are not written by hand, each uri once.

    Null uris are no files; blank files no cases. The kinds are vendored, generated, minified and
    data; a file of several rows or kinds has the first of them by name. Whole texts are judged, each
    by itself, in one map stage; only uris and kinds are shuffled. Rows of any content_type take part
    in the trees.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = batch.column("uri").to_pylist()
            found = [(u, k) for u, t in zip(uris, batch.column("text").to_pylist(), strict=True) if (k := kind_of(u, t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["uri", "kind"])

    code = documents.where((F.col("content_type") == "code") & F.col("uri").isNotNull()).select("uri", "text")
    shared = code.select("uri").join(shared_files(documents), "uri", "left_semi").withColumn("kind", F.lit("vendored"))
    return code.mapInArrow(judge, "uri string, kind string").unionByName(shared).groupBy("uri").agg(F.min("kind").alias("kind"))
