"""Comparison of multisets and of row versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: occurrences in both (common), only in a, only in b.  Both sides are counted before they meet."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    met = n(a, "na").join(n(b, "nb"), keys, "full").fillna(0, ["na", "nb"])
    return met.select(*keys, F.least("na", "nb").alias("common"), F.greatest(F.col("na") - F.col("nb"), F.lit(0)).alias("only_a"), F.greatest(F.col("nb") - F.col("na"), F.lit(0)).alias("only_b"))


def versions(local: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Incoming rows against local ones: added, unchanged, conflict (with the fields that differ), missing."""
    a, b = local.select(key, F.struct(*fields).alias("a")), incoming.select(key, F.struct(*fields).alias("b"))
    differ = F.concat_ws(",", *[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in fields])
    met = a.join(b, key, "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").when(differ == "", "unchanged").otherwise("conflict")
    return met.select(key, status.alias("status"), F.when(status == "conflict", differ).otherwise("").alias("fields"))


def upserted(local: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Local rows with the incoming fields where there are any; a row that is missing from incoming stays."""
    a, b = local.select(key, F.struct(*fields).alias("a")), incoming.select(key, F.struct(*fields).alias("b"))
    return a.join(b, key, "full").select(key, *[F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in fields])
