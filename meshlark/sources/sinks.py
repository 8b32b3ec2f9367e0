"""Results written: partitions by scene, versions published by one rename, reports; and what reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def by_scene(df: DataFrame, key: str, path: str) -> None:
    """One folder for each scene, so that reading a scene lists and opens nothing else."""
    df.repartition(key).write.mode("errorifexists").partitionBy(key).parquet(path)


def one_scene(spark: SparkSession, path: str, key: str, scene) -> DataFrame:
    return spark.read.parquet(path).where(F.col(key) == scene)


def publish(df: DataFrame, root: str) -> str:
    """Write a version beside the others; it becomes the current one by the rename of one small file."""
    spark = df.sparkSession
    version = f"v{len(versions(spark, root)):06d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    _point(spark, root, version)
    return version


def versions(spark: SparkSession, root: str) -> list[str]:
    """Versions that were written to their end, oldest first."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in names if n.startswith("v") and fs.exists(jvm(f"{root}/{n}/_SUCCESS")))


def _point(spark: SparkSession, root: str, version: str) -> None:
    fs, _ = _fs(spark, root)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fresh, place = jvm(f"{root}/_next-{uuid.uuid4().hex}"), jvm(f"{root}/CURRENT")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    fs.rename(fresh, place)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that is pointed to; without a pointer (a publisher died between delete and rename) the newest whole one."""
    fs, _ = _fs(spark, root)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    version = spark.read.text(f"{root}/CURRENT").first()["value"] if fs.exists(place) else versions(spark, root)[-1]
    return spark.read.parquet(f"{root}/{version}")


def roll_back(spark: SparkSession, root: str) -> str:
    """Point to the version before the newest; nothing is deleted."""
    before = versions(spark, root)[-2]
    _point(spark, root, before)
    return before


def report(df: DataFrame, path: str) -> DataFrame:
    """A CSV report with a header, and the rows that reading it gives."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def canonical_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """One line for each row: compact JSON with sorted keys, in order of ``keys``."""
    return df.select(*keys, F.to_json(F.struct(*sorted(df.columns))).alias("line")).orderBy(*keys)
