"""Graphs of faces that share welded edges, and ways along them: legs, exposure, eligible components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.functions import sphere
from meshlark.operators import graph, ordered, tin, topology

_CORNERS = [f"{a}{i}" for i in range(3) for a in "xzh"]


def welded(width: int) -> Column:
    """The three corners of a face with x around the map."""
    return F.array(*[F.struct((F.col(f"x{i}") % width).alias("x"), F.col(f"z{i}").alias("z"), F.col(f"h{i}").alias("h")) for i in range(3)])


def centre(a: str) -> Column:
    return (F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3.0


def neighbours(faces: DataFrame, width: int, *carried: str) -> DataFrame:
    """Pairs src < dst of faces that alone share a welded edge, neither with a duplicate.

    Columns of the faces that are carried come as name_src and name_dst, so pairs need not be joined with the faces again.
    """
    single = tin.with_duplicates(faces.select("face", *_CORNERS, *carried))
    around = single.withColumns({f"x{i}": F.col(f"x{i}") % width for i in range(3)})
    ends = [pick(c, "face").alias(f"{c}_{end}") for c in carried for pick, end in ((F.min_by, "src"), (F.max_by, "dst"))]
    e = topology.occurrences(around).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("face").alias("src"), F.max("face").alias("dst"), F.max("dup_count").alias("dup"), *ends)
    return e.where("n = 2 AND src <> dst AND dup = 1 AND a <> b").select("src", "dst", *[f"{c}_{end}" for c in carried for end in ("src", "dst")]).distinct()


def weighted(faces: DataFrame, width: int, height: int) -> DataFrame:
    """Arcs (both ways) between neighbours with the great-circle distance of their centres in whole millimetres."""
    lon, lat = sphere.to_geographic(centre("x"), centre("z"), width, height)
    pairs = neighbours(faces.withColumns({"lon": lon, "lat": lat}), width, "lon", "lat")
    # the distance is the same both ways, to the last digit
    d = sphere.haversine(F.col("lon_src"), F.col("lat_src"), F.col("lon_dst"), F.col("lat_dst"))
    return graph.both_ways(pairs.select("src", "dst", F.round(d * 1000).cast("long").alias("weight")))


def eligible_components(faces: DataFrame, width: int, eligible: Column) -> DataFrame:
    """face, component (numbered from 0 in order of the smallest face), faces and doubled area of the component, among eligible faces."""
    own = tin.metrics(faces).where(eligible).select(F.col("face").alias("node"), "area2")
    ends = own.select("node")
    links = neighbours(faces.withColumn("may", F.coalesce(eligible, F.lit(False))), width, "may").where("may_src AND may_dst")
    label = graph.cut(own.join(graph.components(ends, links), "node"))
    sums = label.groupBy("label").agg(F.count("*").alias("faces"), F.sum("area2").alias("area2"), F.lit(1).cast("long").alias("one"))
    number = ordered.offsets(sums.select("label", "one"), "label", "one").select("label", F.col("offset").alias("component"))
    return label.select("node", "label").join(sums.drop("one").join(number, "label"), "label").select(F.col("node").alias("face"), "component", "faces", "area2")


def legs(steps: DataFrame, faces: DataFrame, width: int, height: int, deal: str | None = None, heights: bool = True) -> DataFrame:
    """Two legs for each step (trip, seq, src, dst): from the first centre to the middle of the shared edge, and on to the second centre.

    Rows trip, seq, src, part (0, 1), face, status, distance (great circle) and the heights
    where the leg begins and ends.  A step between faces that don't share exactly two
    welded corners is no way along the surface: status error, without a distance.

    Only the different pairs of faces meet the faces, and their ways are computed once: steps, of which there may be many times more,
    get five numbers, or two without the heights.  They are dealt by the column ``deal``, if one is given, while they are one row each.
    """
    corners = faces.select("face", *_CORNERS, welded(width).alias("ring"))
    a = corners.toDF("src", *[f"a{c}" for c in _CORNERS], "ring_a")
    b = corners.toDF("dst", *[f"b{c}" for c in _CORNERS], "ring_b")
    met = steps.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    own = F.array(*[F.struct(F.col(f"ax{i}").alias("x"), F.col(f"az{i}").alias("z"), F.col(f"ah{i}").alias("h")) for i in range(3)])
    shared = F.filter(own, lambda p: F.array_contains(F.col("ring_b"), F.struct((p["x"] % width).alias("x"), p["z"].alias("z"), p["h"].alias("h"))))
    met = met.withColumn("shared", shared)
    mean = lambda f: F.aggregate("shared", F.lit(0.0), lambda s, p: s + p[f]) / 2
    mid = {f: mean(f) for f in "xzh"}
    third = lambda side, f: (F.col(f"{side}{f}0") + F.col(f"{side}{f}1") + F.col(f"{side}{f}2")) / 3.0
    turn = F.floor((third("b", "x") - mid["x"]) / width + 0.5) * width
    good = F.size("shared") == 2

    def distance(x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
        return F.when(good, sphere.central_angle(*sphere.to_geographic(x1, z1, width, height), *sphere.to_geographic(x2, z2, width, height)) * sphere.RADIUS)

    ways = met.select(
        "src", "dst", F.when(good, "ok").otherwise("error").alias("status"), *([third("a", "h").alias("h0"), mid["h"].alias("h1"), third("b", "h").alias("h2")] if heights else []),
        distance(third("a", "x"), third("a", "z"), mid["x"], mid["z"]).alias("d0"), distance(mid["x"] + turn, mid["z"], third("b", "x"), third("b", "z")).alias("d1"),
    )
    rows = steps.join(ways.hint("merge"), ["src", "dst"])
    rows = rows.repartition(deal) if deal else rows
    leg = lambda part, face: F.struct(F.lit(part).alias("part"), F.col(face).alias("face"), F.col(f"d{part}").alias("distance"), *([F.col(f"h{part}").alias("from_h"), F.col(f"h{part + 1}").alias("to_h")] if heights else []))
    return rows.select("trip", "seq", "src", "status", F.explode(F.array(leg(0, "src"), leg(1, "dst"))).alias("l")).select("trip", "seq", "src", "status", "l.*")


def running(rows: DataFrame) -> DataFrame:
    """legs() with the distance along each trip at the end of every leg."""
    w = Window.partitionBy("trip").orderBy("seq", "src", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(F.coalesce("distance", F.lit(0.0))).over(w))


def exposure(rows: DataFrame, faces: DataFrame, by: str) -> DataFrame:
    """Distance and share of all ways by an attribute of the faces they cross."""
    own = rows.where("status = 'ok'").join(faces.select("face", by), "face").groupBy(by).agg(F.sum("distance").alias("distance"), F.count("*").alias("legs"))
    # one row for each value of the attribute
    return own.withColumn("percent", F.try_divide(100.0 * F.col("distance"), F.sum("distance").over(Window.partitionBy())))
