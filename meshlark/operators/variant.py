"""Comparison of two versions of a surface by signatures of their faces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.operators.tin import corner_key, metrics

#: Kinds of agreement within a bucket of equal geometry, and the signatures that must agree.
KINDS = {"winding_common": ("winding",), "attribute_common": ("attribute",), "attribute_winding_common": ("attribute", "winding")}


def _corner(i: int) -> Column:
    return F.struct(F.col(f"x{i}").alias("x"), F.col(f"z{i}").alias("z"), F.col(f"h{i}").alias("h"))


def signed(faces: DataFrame) -> DataFrame:
    """face, area2, geometry (corners without order), winding (order of the corners, from the least rotation), attribute."""
    turns = [F.array(*[_corner((i + k) % 3) for k in range(3)]) for i in range(3)]
    return metrics(faces).select("face", "area2", "terrain", corner_key().alias("geometry"), F.least(*turns).alias("winding"), F.struct("terrain", "script").alias("attribute"))


def buckets(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row per geometry of either side: base_n, other_n, common, ambiguous, status, and a count of each kind.

    Sides are counted by full signature first, so a bucket travels as a few counts and
    no pair of faces is formed.
    """
    both = signed(base).withColumn("side", F.lit(0)).union(signed(other).withColumn("side", F.lit(1)))
    per = both.groupBy("geometry", "winding", "attribute").agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("o"))
    out = per.groupBy("geometry").agg(F.sum("b").alias("base_n"), F.sum("o").alias("other_n"))
    kinds = [per.groupBy("geometry", *cols).agg(F.least(F.sum("b"), F.sum("o")).alias("n")).groupBy("geometry").agg(F.sum("n").alias(name)) for name, cols in KINDS.items()]
    out = reduce(lambda a, k: a.join(k, "geometry"), kinds, out)
    common = F.least("base_n", "other_n")
    status = F.when(common > 0, "common").when(F.col("base_n") > 0, "base_only").otherwise("alternative_only")
    return out.select("*", common.alias("common"), F.expr("base_n > 1 OR other_n > 1").alias("ambiguous"), status.alias("status"))


def by_terrain(base: DataFrame, other: DataFrame) -> DataFrame:
    """terrain, base_faces, other_faces, area2_delta."""
    both = metrics(base).withColumn("side", F.lit(-1)).select("terrain", "side", "area2").union(metrics(other).withColumn("side", F.lit(1)).select("terrain", "side", "area2"))
    return both.groupBy("terrain").agg(F.count_if(F.col("side") == -1).alias("base_faces"), F.count_if(F.col("side") == 1).alias("other_faces"), F.sum(F.col("side") * F.col("area2")).alias("area2_delta"))
