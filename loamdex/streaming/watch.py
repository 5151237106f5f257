"""Changes gathered until they pause, and the loop that scans after each pause.

A file source of the streaming engine only reports new paths, never modified ones, so the live loop
looks at the folder itself on each tick of a rate source.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.sources.filesystem import ScanOptions, walk

#: Milliseconds without a change that end a batch, and between two looks.
DEBOUNCE_MS, POLL_MS = 1000, 100


def debounced(events: DataFrame, seconds: float, time_column: str = "ts", key: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, started, ended, events, members): batches of events, ended by a pause of ``seconds`` or longer.

    ``members`` are the distinct keys of a batch, sorted. Session windows are built within tasks first. Works
    on a stream with a watermark too. Rows without a time are in no batch.
    """
    # A session also takes an event exactly at its end, so the gap is the last microsecond before.
    session = F.session_window(time_column, f"{round(seconds * 1e6) - 1} microseconds")
    rows = events.where(F.col(time_column).isNotNull()).groupBy(*by, session).agg(F.min(time_column).alias("started"), F.max(time_column).alias("ended"), F.count("*").alias("events"), F.sort_array(F.collect_set(key)).alias("members"))
    return rows.drop("session_window")


def debounced_counts(events: DataFrame, seconds: int, time_column: str, key: str) -> DataFrame:
    """(started, ended, events, members) with ``members`` as a number: batches over a table of any size.

    The batches are found in range partitions by time, each numbered from where the one before ends, so no
    task sees the whole table though a batch has no other key.
    """
    # Microseconds since 1970, whether the times have a zone or not.
    start = F.lit("1970-01-01 00:00:00").cast(events.schema[time_column].dataType)
    at = F.timestamp_diff("MICROSECOND", start, F.col(time_column))
    rows = events.where(F.col(time_column).isNotNull()).select(F.col(time_column).alias("t"), at.alias("at"), F.col(key).alias("k")).withColumn("d", F.floor(F.col("at") / 86_400_000_000))
    gap = seconds * 1_000_000
    inside = Window.partitionBy("d").orderBy("at", "k")
    lag = F.col("at") - F.lag("at").over(inside)
    # A day's first row is compared with the last row of the day before that has any: a row a day.
    ends = rows.groupBy("d").agg(F.max("at").alias("last"))
    before = ends.withColumn("prior", F.lag("last").over(Window.orderBy("d"))).select("d", "prior")
    marked = rows.withColumn("lag", lag).join(before, "d").withColumn("lag", F.coalesce("lag", F.col("at") - F.col("prior")))
    starts = marked.withColumn("new", F.coalesce(F.col("lag") >= gap, F.lit(True)).cast("int"))
    total = starts.groupBy("d").agg(F.sum("new").alias("n"))
    base = total.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("d", "base")
    numbered = starts.withColumn("batch", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(base, "d").withColumn("batch", F.col("batch") + F.col("base"))
    return numbered.groupBy("batch").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count("*").alias("events"), F.countDistinct("k").alias("members")).drop("batch")


class Debouncer:
    """Paths gathered until none came for a while."""

    def __init__(self, debounce_ms: int = DEBOUNCE_MS, clock: Callable[[], float] = time.monotonic):
        self.pause, self.clock, self.paths, self.last = debounce_ms / 1000, clock, set(), 0.0

    def add(self, path: str) -> None:
        """Any event puts off the batch; only files that exist are in it."""
        self.last = self.clock()
        if os.path.isfile(path):
            self.paths.add(path)

    def take(self) -> list[str] | None:
        """The batch, if it is complete."""
        if not self.paths or self.clock() - self.last < self.pause:
            return None
        out, self.paths = sorted(self.paths), set()
        return out


class FolderWatcher:
    """Which files of some folders are new or modified since the last look."""

    def __init__(self, paths: list[str], options: ScanOptions | None = None):
        self.options = options or ScanOptions()
        self.paths, self.seen = paths, {}
        self.look()

    def look(self) -> list[str]:
        now = {p: (s, os.stat(p).st_mtime_ns) for root in self.paths for p, s, _ in walk(root, self.options) if os.path.exists(p)}
        changed = sorted(p for p, v in now.items() if self.seen.get(p) != v)
        self.seen = now
        return changed


def parent_folders(paths: list[str]) -> list[str]:
    return sorted({os.path.dirname(p) for p in paths})


def watch(spark: SparkSession, paths: list[str], on_change: Callable[[list[str]], None], debounce_ms: int = DEBOUNCE_MS, checkpoint: str | None = None, stop: threading.Event | None = None):
    """A running query that calls ``on_change`` with the folders of changed files after each pause.

    Ticks of a rate source are handed to foreachBatch on the driver. Returns the streaming query; it ends
    when ``stop`` is set or its own stop() is called.
    """
    watcher, gathered = FolderWatcher(paths), Debouncer(debounce_ms)

    def tick(_: DataFrame, __: int) -> None:
        for p in watcher.look():
            gathered.add(p)
        if batch := gathered.take():
            on_change(parent_folders(batch))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1000 // POLL_MS).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{POLL_MS} milliseconds")
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    if stop is not None:
        threading.Thread(target=lambda: (stop.wait(), query.stop()), daemon=True).start()
    return query
