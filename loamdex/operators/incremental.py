"""Incremental processing: only what is new or changed since the last successful run.

Method: a high watermark over a monotonic commit sequence. A run fixes its upper limit when it
starts, takes the records in (watermark, limit], and publishes its output and the new watermark in
one atomic step. A run that fails before that step leaves nothing visible; the next run takes the
same records again, so none is skipped and none is repeated.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Commits after which the state a job keeps is rewritten as one folder.
COMPACT_EVERY = 16


class LateRecords(RuntimeError):
    """Records arrived at or below the watermark: the sequence isn't monotonic, and no run would take them."""


class CommitConflict(RuntimeError):
    """Another run has committed in the meantime."""


def due(records: DataFrame, seq: str, low: int | None, limit: int) -> DataFrame:
    """The records in (low, limit] of the sequence; null sequences are never due. Pushed to the scan."""
    rows = records.where(F.col(seq) <= limit)
    return rows if low is None else rows.where(F.col(seq) > low)


class IncrementalJob:
    """A job over an append-only table that runs again and again, each time over the new rows only.

    State lives below ``state_dir`` on any Hadoop file system with an atomic rename: each attempt
    writes a folder of its own, ``staged/<number>-<attempt>``; ``commits/<number>.json`` names the
    folder that won, the watermark it reaches and the folders that make up the state. Creating that
    file is the atomic step, and fails where the file exists. Folders that no commit names are
    ignored; an attempt that loses deletes its own.

    The sequence must be monotonic: rows may only be appended above the largest one there. A commit
    records how many rows lie up to its watermark, and the next run refuses with LateRecords if
    there are more now, instead of losing them in silence. Where appends are still open at the
    largest value, give a ``limit`` below it.
    """

    def __init__(self, spark: SparkSession, state_dir: str, seq_col: str):
        self.spark, self.dir, self.seq_col = spark, state_dir.rstrip("/"), seq_col
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last_commit(self) -> dict | None:
        """The newest commit; earlier ones aren't read."""
        folder = self._path(f"{self.dir}/commits")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        done = [n for n in names if n.endswith(".json")]
        return json.loads(self._read(f"{self.dir}/commits/{max(done)}")) if done else None

    def watermark(self) -> int | None:
        last = self.last_commit()
        return last and last["watermark"]

    def state(self, last: dict | None) -> DataFrame | None:
        """Everything that commits up to ``last`` have written, oldest rows compacted."""
        return self._table(last, last["state"]) if last else None

    def _table(self, commit: dict, paths: list[str]) -> DataFrame:
        """Folders of a commit's schema, which then needs no look into their files."""
        return self.spark.read.schema(StructType.fromJson(commit["schema"])).parquet(*paths)

    def run(self, records: DataFrame, transform: Callable[..., DataFrame], limit: int | None = None, compact: Callable[[DataFrame], DataFrame] | None = None, stateful: bool = False, verify: bool = True) -> dict | None:
        """Process the rows in (watermark, limit]; ``limit`` defaults to the largest sequence now.

        ``transform`` gets the due rows, and with ``stateful`` also what was committed before (or
        None) and the number of this commit. With ``compact`` that state is rewritten through it
        every COMPACT_EVERY commits. Without ``verify`` the sequence's column isn't counted, so that
        only the due rows are read: for a table that can't change meanwhile. Returns the commit, or None when the limit is not above the
        watermark (or nothing has a sequence). If anything fails before the commit, the watermark
        stays where it was and the rows are due again.
        """
        last = self.last_commit()
        low, number = (last["watermark"], last["number"] + 1) if last else (None, 0)
        upto = None
        if verify or limit is None:
            at = F.col(self.seq_col)
            below = F.lit(False) if low is None else at <= low
            counted = F.lit(True) if limit is None else at <= limit
            top, old, upto = records.where(at.isNotNull()).agg(F.max(at), F.count_if(below), F.count_if(counted)).collect()[0]
            limit = top if limit is None else limit
            if verify and last and last["rows"] is not None and old != last["rows"]:
                raise LateRecords(f"{old - last['rows']} rows arrived at or below the watermark {low}")
        if limit is None or (low is not None and limit <= low):
            return None
        attempt = uuid.uuid4().hex
        out = f"{self.dir}/staged/{number:09d}-{attempt}"
        given = due(records, self.seq_col, low, limit)
        try:
            made = transform(given, self.state(last), number) if stateful else transform(given)
            made.write.parquet(out)
            commit = {"number": number, "low": low, "watermark": limit, "rows": upto, "output": out, "state": [*(last["state"] if last else []), out], "schema": json.loads(made.schema.json())}
            if compact and len(commit["state"]) > COMPACT_EVERY:
                compact(self.state(commit)).write.parquet(f"{out}-state")
                commit["state"] = [f"{out}-state"]
            self._publish(f"{self.dir}/commits/{number:09d}.json", json.dumps(commit))
        except BaseException:
            for path in (out, f"{out}-state"):
                self._fs.delete(self._path(path), True)
            raise
        return commit

    def output(self) -> DataFrame | None:
        """The rows of all commits."""
        last = self.last_commit()
        if last is None:
            return None
        paths = [r["output"] for r in self.spark.read.schema("output string").json(f"{self.dir}/commits/*.json").toLocalIterator()]
        return self._table(last, paths)

    def _publish(self, target: str, text: str) -> None:
        part = f"{target}.{uuid.uuid4().hex}.part"
        stream = self._fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.getScheme() == "file":
            # A rename on a local disk replaces the target; a link does not.
            bare = [self._path(x).toUri().getPath() for x in (part, target)]
            try:
                os.link(*bare)
                return
            except FileExistsError as e:
                raise CommitConflict(f"{target} was committed by another run") from e
            finally:
                os.remove(bare[0])
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(part), self._path(target)):
            self._fs.delete(self._path(part), False)
            raise CommitConflict(f"{target} was committed by another run")

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def changed_files(given: DataFrame, state: DataFrame | None, number: int, run_id: int) -> DataFrame:
    """(uri, content_hash, gone, number, run_id, is_case) of the files that ``given`` takes, one row each.

    Of the rows of a uri the last by (indexed_at, source_id) counts. It is a case unless it is deleted
    or its content_hash equals (null-safe) the one that counted when the uri was last taken; after a
    deleted row, or with no earlier one, it is always a case. Rows are reduced within partitions
    before the shuffle, so a uri with a third of all rows costs one row a task.
    """
    gone = F.coalesce("status", F.lit("indexed")) == "deleted"
    slim = given.where(F.col("uri").isNotNull())
    now = slim.groupBy("uri").agg(F.max_by(F.struct("content_hash", gone.alias("gone")), F.struct("indexed_at", "source_id")).alias("now")).select("uri", "now.*")
    if state is None:
        case = ~F.col("gone")
    else:
        before = latest_state(state).select("uri", F.col("content_hash").alias("old_hash"), F.col("gone").alias("was_gone"))
        now = now.join(before, "uri", "left")
        same = F.coalesce(~F.col("was_gone"), F.lit(False)) & F.col("old_hash").eqNullSafe(F.col("content_hash"))
        case = ~F.col("gone") & ~same
    return now.select("uri", "content_hash", "gone", F.lit(number).alias("number"), F.lit(run_id).alias("run_id"), case.alias("is_case"))


def latest_state(state: DataFrame) -> DataFrame:
    """The newest row of each uri."""
    newest = F.max_by(F.struct("content_hash", "gone", "number", "run_id", "is_case"), "number").alias("s")
    return state.groupBy("uri").agg(newest).select("uri", "s.*")


def replay_changes(sources: DataFrame, runs: DataFrame, state_dir: str) -> DataFrame:
    """(run_id, uri): for each successful run the files new or changed since they were last taken.

    The run log is replayed through an :class:`IncrementalJob`, run by run: a successful run takes
    the rows with watermark < indexed_at <= its finished_at, judges them by :func:`changed_files`
    and commits cases, state and watermark together. A run without success, without finished_at, or
    whose limit is not above the watermark commits nothing; its rows stay due. ``modified_at`` plays
    no part. Null uris are no files, null status means indexed, repeated rows change nothing, rows
    after the last successful run are not taken. An empty table or run log gives no rows; run_id keeps
    its type. The log is read row by row, so its length is not bounded by memory. Each run reads only
    its own rows; they can't change during the replay, so late rows aren't looked for.
    """
    spark = sources.sparkSession
    job = IncrementalJob(spark, state_dir, "indexed_at")
    records = sources.select("uri", "content_hash", "status", "indexed_at", "source_id")
    kind = runs.schema["run_id"].dataType
    ok = runs.where((F.col("status") == "success") & F.col("finished_at").isNotNull()).groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
    for run_id, limit in ok.orderBy("run_id").toLocalIterator():
        job.run(records, lambda given, state, number, r=run_id: changed_files(given, state, number, r), limit=limit, compact=latest_state, stateful=True, verify=False)
    done = job.output()
    if done is None:
        return sources.where(F.lit(False)).select(F.lit(None).cast(kind).alias("run_id"), "uri")
    return done.where("is_case").select(F.col("run_id").cast(kind).alias("run_id"), "uri")
