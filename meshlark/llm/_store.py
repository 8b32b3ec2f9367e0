"""Shared folder of the cluster, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that of SparkContext.setCheckpointDir.

    Where neither is set there is none: a folder of the driver's own would be another one on each executor.
    A local master alone (tests) gets the warehouse's folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not (spark.sparkContext.master or "").partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/meshlark-shared"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again, so that later stages don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshlark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._meshlark_path = path
    return out


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A table that materialise() wrote, to be broadcast where it has no more than ``most`` (short) rows; beyond, joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def release(df: DataFrame) -> None:
    """Remove a table that materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_meshlark_path", None)
    for entry in [x for x in _WRITTEN if x[1] == path]:
        _WRITTEN.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


@atexit.register
def _sweep() -> None:
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


#: Rows and bytes of the batches that Python workers get, in place of Spark's own 10,000 rows and 64 MB: whole texts are wide.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and send them small batches (settings of the user's own stay)."""
    for name, (usual, ours) in _BATCHES.items():
        if (spark.conf.get(name, usual) or usual).rstrip("b") == usual:
            spark.conf.set(name, ours)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
