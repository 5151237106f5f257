"""References to records that do not exist, are deleted, or arrive later.

Method: parent keys become integers, are sorted and compressed into contiguous runs; each distinct
reference is matched as-of to the run that starts at or before it, and is an orphan if it lies
beyond that run's end. Integer keys are used as they are. Other keys are numbered densely together
with the references' keys, in their own order, so that only an orphan breaks a run and being in a
run is exactly being a parent key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import shuffle_partitions

#: Integer keys of a block share their higher bits. Runs never cross a block, so the as-of match needs
#: no global order.
INT_BLOCK_SHIFT = 20
#: Blocks of numbered keys for each shuffle partition.
BLOCKS_PER_PARTITION = 4
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _coded(df: DataFrame, key: str) -> tuple[Column, Column]:
    """(key as bytes, key as an integer or null): equal keys of one type have equal bytes."""
    kind = dict(df.dtypes)[key]
    code = F.col(key).cast("bigint") if kind in INTEGERS else F.lit(None).cast("bigint")
    return (F.col(key) if kind == "binary" else F.col(key).cast("string").cast("binary")), code


def number_keys(keys: DataFrame) -> DataFrame:
    """``keys`` (distinct field, key, code) plus ``block`` and ``number``, integers in key order within a block."""
    blocks = F.lit(max(64, BLOCKS_PER_PARTITION * shuffle_partitions(keys.sparkSession)))
    block = F.coalesce(F.shiftright("code", INT_BLOCK_SHIFT), F.pmod(F.xxhash64("key"), blocks).cast("bigint"))
    w = Window.partitionBy("field", "block").orderBy("code", "key")
    return keys.withColumn("block", block).withColumn("number", F.coalesce("code", F.row_number().over(w).cast("bigint")))


def key_runs(parents: DataFrame) -> DataFrame:
    """(field, block, run_start, run_end): sorted distinct numbers as maximal runs without a gap."""
    w = Window.partitionBy("field", "block").orderBy("number")
    marked = parents.select("field", "block", "number", (F.col("number") - F.row_number().over(w)).alias("_island"))
    return marked.groupBy("field", "block", "_island").agg(F.min("number").alias("run_start"), F.max("number").alias("run_end")).drop("_island")


def asof_orphans(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """``refs`` plus ``in_run``: whether the run that starts at or before the number reaches it."""
    starts = runs.select("field", "block", F.col("run_start").alias("number"), "run_end", F.lit(0).alias("_ref"))
    events = refs.withColumn("_ref", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("field", "block").orderBy("number", "_ref").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("_end", F.last("run_end", ignorenulls=True).over(w)).where(F.col("_ref") == 1)
    return seen.withColumn("in_run", F.coalesce(F.col("number") <= F.col("_end"), F.lit(False))).drop("_end", "_ref", "run_end")


def broken_references(children: DataFrame, id_col: str, child_at: str, specs: list[dict]) -> DataFrame:
    """(ref_field, id, reason, period) of every broken reference of ``children``.

    Each spec has ``field``, ``parents``, ``parent_key``, ``at`` and optionally ``order_id`` and
    ``gone`` (a column over parents). Reasons, first that holds: missing (no such key), deleted
    (the key's last row by (at, order_id) is gone), late (the key's first row is after the child). A
    null reference is no reference; keys match only if exactly equal; a parent with a null time exists
    all the same; a null child time is never late and gives a null period. Repeated parents count
    once, by their first and last row. Without parents every reference is missing; without children
    there are no rows. ``period`` is the child's month in UTC, YYYY-MM, in any session time zone.

    The children are read twice, whatever the number of fields. First their distinct keys are counted
    within partitions and meet the parents' keys, so a key that a third of the rows refer to is one row
    a task. Only keys that break some reference (missing, gone, or first seen after the earliest child)
    come back to the children's rows, in a join whose hot keys the adaptive execution splits.
    """
    fields = []
    for s in specs:
        key, code = _coded(children, s["field"])
        fields.append(F.struct(F.lit(s["field"]).alias("field"), key.alias("key"), code.alias("code")))
    rows = children.select(F.col(id_col), F.col(child_at).alias("_at"), F.explode(F.array(*fields)).alias("r")).select(id_col, "_at", "r.*").where(F.col("key").isNotNull())
    asked = rows.groupBy("field", "key").agg(F.max("code").alias("code"), F.min("_at").alias("least_at"), F.lit(True).alias("is_ref"))
    parents = []
    for s in specs:
        key, code = _coded(s["parents"], s["parent_key"])
        gone = F.lit(False) if s.get("gone") is None else s["gone"]
        order = F.struct(F.col(s["at"]).cast("bigint"), (F.col(s["order_id"]) if s.get("order_id") else F.lit(0)).cast("bigint"))
        parents.append(s["parents"].where(F.col(s["parent_key"]).isNotNull()).select(F.lit(s["field"]).alias("field"), key.alias("key"), code.alias("code"), F.col(s["at"]).cast("bigint").alias("at"), order.alias("order"), F.coalesce(gone, F.lit(False)).alias("gone")))
    held = reduce(DataFrame.unionByName, parents).groupBy("field", "key").agg(F.max("code").alias("code"), F.min("at").alias("first_at"), F.max_by("gone", "order").alias("is_gone"), F.lit(True).alias("is_parent"))
    # One row a key: both sides were reduced to that before.
    merged = asked.unionByName(held, allowMissingColumns=True).groupBy("field", "key").agg(*[F.max(c).alias(c) for c in ("code", "least_at", "is_ref", "first_at", "is_gone", "is_parent")])
    numbered = number_keys(merged)
    verdict = asof_orphans(numbered.where("is_ref").drop("is_ref", "is_parent", "code"), key_runs(numbered.where("is_parent")))
    bad = verdict.where(~F.col("in_run") | F.coalesce("is_gone", F.lit(False)) | F.coalesce(F.col("first_at") > F.col("least_at"), F.lit(False)))
    j = rows.select(id_col, "_at", "field", "key").join(bad.select("field", "key", "in_run", "is_gone", "first_at"), ["field", "key"])
    reason = F.when(~F.col("in_run"), "missing").when(F.col("is_gone"), "deleted").when(F.col("first_at") > F.col("_at"), "late")
    period = F.date_format(F.date_from_unix_date(F.floor(F.col("_at") / 86400).cast("int")), "yyyy-MM")
    return j.select(F.col("field").alias("ref_field"), id_col, reason.alias("reason"), period.alias("period")).where(F.col("reason").isNotNull())


def orphan_report(found: DataFrame) -> DataFrame:
    """Broken references counted per field, reason and period."""
    return found.groupBy("ref_field", "reason", "period").agg(F.count("*").alias("n"))
