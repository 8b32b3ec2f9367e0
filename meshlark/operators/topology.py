"""Edges of a surface: incidence, flags, seams, adjacency of regions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.operators import tin

BOUNDARY, NONMANIFOLD, COLLAPSED, DUPLICATE, PERIODIC, AMBIGUOUS, REPEATED = 1, 2, 4, 8, 16, 32, 64


def occurrences(faces: DataFrame) -> DataFrame:
    """One row per face side: face, slot, end points a <= b, with the columns of the face."""
    point = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"z{i}").alias("z"), F.col(f"h{i}").alias("h"))
    sides = F.array(*[F.struct(F.lit(i).alias("slot"), F.least(point(i), point((i + 1) % 3)).alias("a"), F.greatest(point(i), point((i + 1) % 3)).alias("b")) for i in range(3)])
    rest = [c for c in faces.columns if c not in ("x0", "z0", "h0", "x1", "z1", "h1", "x2", "z2", "h2")]
    return faces.select(*rest, F.explode(sides).alias("e")).select(*rest, "e.slot", "e.a", "e.b")


def edges(faces: DataFrame, width: int) -> DataFrame:
    """One row per edge: ends, incidence, flags (bits), side (west, east or null), seam status, and of the faces there what joins them.

    Rows are dealt once, by a hash of the edge (on the seam of what its two sides have in
    common), and counted and paired where they are; nothing is joined, so nothing can be broadcast.
    """
    occ = occurrences(tin.metrics(tin.with_duplicates(faces)))
    side = F.when(F.col("a.x") == F.col("b.x"), F.when(F.col("a.x") == 0, "west").when(F.col("a.x") == width, "east"))
    # two sides of the seam fit if their ends agree in z and h
    key = {"lo": F.least(F.struct("a.z", "a.h"), F.struct("b.z", "b.h")), "hi": F.greatest(F.struct("a.z", "a.h"), F.struct("b.z", "b.h"))}
    dealt = occ.withColumn("deal", F.when(side.isNotNull(), F.xxhash64(key["lo"], key["hi"])).otherwise(F.xxhash64("a", "b"))).repartition("deal")
    per = dealt.groupBy("deal", "a", "b", "face").agg(F.count("*").alias("times"), F.max("dup_count").alias("dup"), F.max("degenerate_3d").alias("degenerate"), F.first("region").alias("region"))
    e = per.groupBy("deal", "a", "b").agg(
        F.sum("times").alias("incidence"), F.count("*").alias("faces"), F.max(F.col("times") > 1).alias("repeated"), F.max(F.col("dup") > 1).alias("duplicate"), F.max("degenerate").alias("degenerate"), F.min("face").alias("face"), F.max("face").alias("other"),
        F.min_by("region", "face").alias("region"), F.max_by("region", "face").alias("other_region"), F.array_sort(F.collect_set("region")).alias("regions"),
    )
    collapsed = F.col("a") == F.col("b")
    bits = lambda c, bit: F.when(c, bit).otherwise(0)
    e = e.withColumn("side", side).withColumn("ambiguous", collapsed | (F.col("incidence") > 2) | F.col("duplicate") | F.col("repeated"))
    e = e.withColumn("flags", bits(F.col("incidence") == 1, BOUNDARY) + bits(F.col("incidence") > 2, NONMANIFOLD) + bits(collapsed, COLLAPSED) + bits(F.col("duplicate"), DUPLICATE) + bits(F.col("side").isNotNull(), PERIODIC) + bits(F.col("repeated"), REPEATED))
    # a key has one edge on each side at most
    w = Window.partitionBy("deal", "lo", "hi")
    own = F.struct(F.col("incidence").alias("i"), F.col("ambiguous").alias("a"), F.col("face").alias("f"), F.col("region").alias("r"), F.col("degenerate").alias("d"))
    met = e.withColumns({n: F.when(F.col("side").isNotNull(), k) for n, k in key.items()}).withColumns({n: F.max(F.when(F.col("side") == n, own)).over(w) for n in ("west", "east")})
    seam = F.when(F.expr("west IS NULL OR east IS NULL"), "unmatched").when(F.expr("west.i = 1 AND east.i = 1 AND NOT west.a AND NOT east.a AND west.f <> east.f"), "paired").otherwise("ambiguous")
    met = met.withColumn("seam", F.when(F.col("side").isNull(), "none").otherwise(seam))
    across = F.when(F.col("side") == "west", F.col("east")).when(F.col("side") == "east", F.col("west"))
    loose = F.col("ambiguous") | (F.col("side").isNotNull() & (F.col("seam") != "paired"))
    out = met.select("a", "b", "incidence", "faces", (F.col("flags") + bits(loose, AMBIGUOUS)).alias("flags"), "ambiguous", "side", "seam", across["f"].alias("partner"), "face", "other", "region", "other_region", "regions", across["r"].alias("partner_region"), "degenerate", across["d"].alias("partner_degenerate"))
    return out.hint("merge")


def unique_raw() -> str:
    """Condition for an edge that joins two faces beyond doubt."""
    return "incidence = 2 AND faces = 2 AND NOT ambiguous"


def on_seam(faces: DataFrame, width: int) -> DataFrame:
    """Faces with a side on the seam: all that edges() needs for the edges there, as duplicates have the same sides."""
    along = [F.col(f"x{i}") == F.col(f"x{(i + 1) % 3}") for i in range(3)]
    return faces.where(reduce(or_, [c & F.col(f"x{i}").isin(0, width) for i, c in enumerate(along)]))


def neighbours(faces: DataFrame) -> DataFrame:
    """face_a < face_b that share exact edges, and how many: pairs of their sides.

    Equal sides of a face are one row with their number before they meet the others of the edge, so repeated rows don't multiply each other.
    """
    occ = occurrences(faces.select("face", *[f"{a}{i}" for i in range(3) for a in "xzh"]))
    n = occ.repartition("a", "b").groupBy("a", "b", "face").agg(F.count("*").alias("n")).hint("merge")
    met = n.toDF("a", "b", "face_a", "n_a").join(n.toDF("a", "b", "face_b", "n_b"), ["a", "b"]).where("face_a < face_b")
    return met.groupBy("face_a", "face_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("shared"))


def face_flags(faces: DataFrame, width: int) -> DataFrame:
    """Per face the flags of its edges, and the duplicate flag of its own."""
    occ = occurrences(tin.with_duplicates(faces)).select("face", "a", "b", "dup_count")
    e = edges(faces, width).select("a", "b", F.col("flags").bitwiseAND(~DUPLICATE & 127).alias("flags"))
    own = F.when(F.max("dup_count") > 1, DUPLICATE).otherwise(0)
    return occ.join(e, ["a", "b"]).groupBy("face").agg(F.bit_or("flags").bitwiseOR(own).alias("flags"))


def adjacency(faces: DataFrame, width: int) -> DataFrame:
    """Pairs of regions: joining edges, their length, pairs over the seam."""
    raw = F.expr(unique_raw() + " AND region <> other_region AND NOT degenerate")
    over = F.expr("side = 'west' AND seam = 'paired' AND region <> partner_region")
    # an edge of two faces is no pair of the seam, whose edges have one
    e = edges(faces, width).where(raw | over).withColumn("over", F.col("incidence") == 1)
    length = F.when(F.col("over"), 0.0).otherwise(F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.z") - F.col("b.z")) ** 2))
    second = F.when(F.col("over"), F.col("partner_region")).otherwise(F.col("other_region"))
    joined = e.select(F.least("region", second).alias("region_a"), F.greatest("region", second).alias("region_b"), length.alias("length"), "over")
    return joined.groupBy("region_a", "region_b").agg(F.count_if(~F.col("over")).alias("edges"), F.round(F.sum("length"), 6).alias("length"), F.count_if("over").alias("seam_pairs"))


def links(faces: DataFrame, width: int, seams: bool = False) -> DataFrame:
    """Pairs of faces of one region that a sound edge joins (and, if asked, the seam)."""
    raw = F.expr(unique_raw() + " AND region = other_region AND NOT degenerate")
    over = F.expr("side = 'west' AND seam = 'paired' AND region = partner_region AND NOT degenerate AND NOT partner_degenerate")
    e = edges(faces, width).where(raw | over if seams else raw)
    return e.select(F.col("face").alias("src"), F.when(F.col("incidence") == 1, F.col("partner")).otherwise(F.col("other")).alias("dst"))
