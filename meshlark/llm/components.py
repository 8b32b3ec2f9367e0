"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm._store import materialise, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) for every end of an edge; component is the smallest id reachable.

    Each round points every vertex to the smallest of itself and its neighbours (a
    union-find step for all vertices at once), follows the pointers to their ends by
    doubling, and contracts the edges.  Every vertex with an edge joins another, so a
    round at least halves them.  Nothing reaches the driver but whether rows are left.
    Null ends and loops are left out.
    """
    left = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    label = None
    while not left.isEmpty():
        ends = left.union(left.select("b", "a"))
        parent = materialise(ends.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p")), "parents")
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            further = parent.join(up, "p")
            if further.where("pp <> p").isEmpty():
                break
            jumped = materialise(further.select("v", F.col("pp").alias("p")), "parents")
            release(parent)
            parent = jumped
        if label is None:
            new = parent.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            new = label.join(parent, label["component"] == parent["v"], "left").select("id", F.coalesce("p", "component").alias("component"))
        new = materialise(new, "labels")
        of_a, of_b = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        rest = materialise(left.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        for old in (label, parent, left):
            if old is not None:
                release(old)
        label, left = new, rest
    release(left)
    return label if label is not None else edges.select(F.col(a).alias("id"), F.col(a).alias("component")).limit(0)
