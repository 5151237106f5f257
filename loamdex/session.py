"""Reading tables, checked broadcasts and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of an application, once, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loamdex-package-")  # on the driver, which serves it to the others
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "loamdex.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A new schema with further fields; ``schema`` stays as it is."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def collect_bounded(df: DataFrame, max_rows: int) -> list:
    """All rows of a configuration-sized table; raises instead of collecting an unbounded one."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; refusing to bring them to the driver")
    return rows


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared location that spark.checkpoint.dir names.

    Where none is named, a local session gets a temporary folder, removed when the process ends; a
    cluster, whose executors would each write to a disk of their own, is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loamdex-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loamdex-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)
