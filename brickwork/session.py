"""Shared storage, materialisation and size checks.

Nothing here keeps data on the driver: tables that are needed more than once are
written to the folder all executors share, so a lost executor costs a re-read and
never a recomputation of the whole lineage.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast, in bytes by the planner's estimate, which for a stored table is the size of its files.
BROADCAST_BYTES = 10 << 20


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="brickwork-"), "brickwork")
    archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """Return the folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="brickwork-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """Return a new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Run ``df`` once, keep it as Parquet in the shared folder and return the stored table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the planner's estimate; no job runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its planned size is small; else adaptive execution decides by the size found."""
    return F.broadcast(df) if planned_bytes(df) <= max_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows, or keys, out to all shuffle partitions ahead of a step that multiplies them.

    A fixed number keeps adaptive execution from merging partitions that are small only
    until each row becomes many.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]):
    """Null-safe equality of ``keys`` on both sides."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
