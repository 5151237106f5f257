import random

import pytest
from pyspark.sql import functions as F

from loamdex.operators import references
from loamdex.operators.references import broken_references, orphan_report


def found(children, parents, **spec):
    rows = broken_references(children, "chunk_id", "indexed_at", [{"field": "k", "parents": parents, "parent_key": "k", "at": "at", **spec}]).collect()
    return sorted((r["chunk_id"], r["reason"], r["period"]) for r in rows)


def test_reasons_and_nulls(spark):
    children = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, None), (4, None, "b"), (5, 5, "c"), (6, 5, "d"), (7, None, "d"), (8, 5, "e")], "chunk_id bigint, indexed_at bigint, k string")
    parents = spark.createDataFrame([("a", None, 1, False), ("c", 1, 1, False), ("c", 2, 2, True), ("d", 9, 1, None), ("e", 5, 1, False), (None, 1, 1, True)], "k string, at bigint, id bigint, dead boolean")
    month = "1970-01"
    assert found(children, parents, order_id="id", gone=F.col("dead")) == [(2, "missing", month), (4, "missing", None), (5, "deleted", month), (6, "late", month)]
    assert found(children, parents.limit(0)) == [(i, "missing", None if i in (4, 7) else month) for i in (1, 2, 4, 5, 6, 7, 8)]
    assert found(children.limit(0), parents) == []


def test_the_month_does_not_depend_on_the_time_zone(spark):
    children = spark.createDataFrame([(1, 1704067200, "x")], "chunk_id bigint, indexed_at bigint, k string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert found(children, children.limit(0).select("k", F.col("indexed_at").alias("at"))) == [(1, "missing", "2024-01")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("kind", ["bigint", "string", "binary"])
def test_equals_a_plain_set_for_every_type_of_key(spark, kind):
    rng = random.Random(7)
    make = {"bigint": lambda x: x * 3 if x % 2 else x - 2**40, "string": lambda x: f"ü{x}", "binary": lambda x: bytes([x % 256, x // 256])}[kind]
    asked, held = [rng.randrange(600) for _ in range(900)], [rng.randrange(500) for _ in range(500)]
    children = spark.createDataFrame([(i, 5, make(x)) for i, x in enumerate(asked)], f"chunk_id bigint, indexed_at bigint, k {kind}")
    parents = spark.createDataFrame([(make(x), 1) for x in held], f"k {kind}, at bigint")
    assert [r[0] for r in found(children, parents)] == [i for i, x in enumerate(asked) if x not in set(held)]


def test_runs_decide(spark, monkeypatch):
    children = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "chunk_id bigint, indexed_at bigint, k string")
    parents = spark.createDataFrame([("a", 1)], "k string, at bigint")
    assert [r[0] for r in found(children, parents)] == [2]
    monkeypatch.setattr(references, "asof_orphans", lambda refs, runs: refs.withColumn("in_run", F.lit(True)))
    assert found(children, parents) == []


def test_runs_are_maximal(spark):
    keys = spark.createDataFrame([("f", 0, x) for x in (1, 2, 3, 7, 8, 10)], "field string, block bigint, number bigint")
    assert sorted((r["run_start"], r["run_end"]) for r in references.key_runs(keys).collect()) == [(1, 3), (7, 8), (10, 10)]


def test_report_counts(spark):
    rows = spark.createDataFrame([("f", 1, "late", "2024-01"), ("f", 2, "late", "2024-01")], "ref_field string, id bigint, reason string, period string")
    assert [tuple(r) for r in orphan_report(rows).collect()] == [("f", "late", "2024-01", 2)]
