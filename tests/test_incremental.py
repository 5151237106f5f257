import threading

import pytest
from pyspark.sql import functions as F

from loamdex.operators.incremental import COMPACT_EVERY, CommitConflict, IncrementalJob, LateRecords, replay_changes


@pytest.fixture
def job(spark, tmp_path):
    return IncrementalJob(spark, str(tmp_path / "state"), "seq")


def rows_of(spark, *seq):
    return spark.createDataFrame([(x,) for x in seq], "seq bigint")


def done(job):
    out = job.output()
    return sorted(r["seq"] for r in out.collect()) if out is not None else []


def test_an_attempt_that_loses_leaves_the_committed_rows(spark, job):
    records = rows_of(spark, 1, 2)

    def overtaken(given):
        IncrementalJob(spark, job.dir, "seq").run(records, lambda x: x, limit=1)
        return given

    with pytest.raises(CommitConflict):
        job.run(records, overtaken, limit=2)
    assert done(job) == [1]
    job.run(records, lambda x: x)
    assert done(job) == [1, 2]


def test_a_failure_before_the_write_or_the_commit_leaves_the_rows_due(spark, job, monkeypatch):
    records = rows_of(spark, 1, 2, 3)

    def fails(*_):
        raise OSError("lost")

    with pytest.raises(OSError):
        job.run(records, fails)
    monkeypatch.setattr(job, "_publish", fails)
    with pytest.raises(OSError):
        job.run(records, lambda x: x)
    assert job.watermark() is None and done(job) == []
    monkeypatch.undo()
    assert job.run(records, lambda x: x)["watermark"] == 3
    assert done(job) == [1, 2, 3]
    assert job.run(records, lambda x: x) is None


def test_only_one_of_many_commits_wins(spark, job):
    job._fs.mkdirs(job._path(f"{job.dir}/commits"))
    won = []

    def attempt(i):
        try:
            job._publish(f"{job.dir}/commits/000000000.json", '{"i": %d}' % i)
            won.append(i)
        except CommitConflict:
            pass

    threads = [threading.Thread(target=attempt, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and job.last_commit() == {"i": won[0]}


def test_late_rows_are_refused_and_null_sequences_never_due(spark, job):
    job.run(rows_of(spark, 1, 5, None), lambda x: x)
    with pytest.raises(LateRecords):
        job.run(rows_of(spark, 1, 5, 4, 7), lambda x: x)
    job.run(rows_of(spark, 1, 5, 7, None), lambda x: x)
    assert done(job) == [1, 5, 7]


def test_the_limit_is_fixed_when_a_run_starts(spark, job):
    job.run(rows_of(spark, 1, 2, 9), lambda x: x, limit=2)
    assert done(job) == [1, 2]
    assert job.run(rows_of(spark, 1, 2, 9), lambda x: x, limit=2) is None


SOURCE = "source_id bigint, uri string, content_hash binary, indexed_at bigint, status string"
RUN = "run_id int, started_at bigint, finished_at bigint, status string"


def test_replay_takes_what_failed_runs_left(spark, tmp_path):
    sources = [(1, "a", b"1", 5, None), (2, "a", b"1", 15, None), (3, "b", b"1", 15, "indexed"), (4, "a", b"2", 25, None), (5, "b", b"1", 25, "deleted"), (6, "b", b"1", 35, None), (7, None, b"1", 5, None), (8, "c", b"1", 99, None), (9, "d", None, 35, None)]
    runs = [(1, 0, 10, "success"), (2, 0, 20, "failed"), (3, 0, None, "success"), (4, 0, 30, "success"), (5, 0, 40, "success"), (6, 0, 40, "cancelled")]
    found = replay_changes(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(runs, RUN), str(tmp_path / "s"))
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (4, "a"), (5, "b"), (5, "d")]
    assert found.schema["run_id"].dataType.typeName() == "integer"


def test_replay_of_nothing_and_over_a_compaction(spark, tmp_path):
    empty = spark.createDataFrame([], SOURCE)
    assert replay_changes(empty, spark.createDataFrame([], RUN), str(tmp_path / "e")).collect() == []
    n = COMPACT_EVERY + 3
    # The same file changes on every second run only.
    sources = spark.createDataFrame([(i, "a", bytes([i // 2]), i, None) for i in range(n)], SOURCE)
    runs = spark.createDataFrame([(i, i, i, "success") for i in range(n)], RUN)
    found = replay_changes(sources, runs, str(tmp_path / "c"))
    assert sorted(r["run_id"] for r in found.collect()) == [i for i in range(n) if i % 2 == 0]
    assert found.where(F.col("uri") != "a").count() == 0
