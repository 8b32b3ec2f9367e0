"""Cuts of faces along segments: sides are told by whole numbers, places on the segment are their quotients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.operators.tin import in_cells, levels_of, metrics


def _met(faces: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """Pairs of faces and segments whose bounds touch, each once.

    Both lie in the cells of a grid, so the join is an equi-join; faces lie in the level
    where they touch few cells, segments in the cells of every level that they cross, and
    a pair that meets in several cells is kept in the first common one.
    """
    f = in_cells(metrics(faces), cell)
    levels = levels_of(f)
    size = cell * F.pow(F.lit(2.0), F.col("level"))
    f = f.withColumn("fx", F.floor(F.col("minx") / size)).withColumn("fz", F.floor(F.col("minz") / size))
    s = segments.select("*", F.least("sx", "ex").alias("lx"), F.greatest("sx", "ex").alias("hx"), F.least("sz", "ez").alias("lz"), F.greatest("sz", "ez").alias("hz"), F.explode(F.array(*[F.lit(n) for n in levels or [0]])).alias("level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    s = s.withColumn("gx", F.floor(F.col("lx") / size)).withColumn("gz", F.floor(F.col("lz") / size)).withColumn("cx", F.explode(span("lx", "hx"))).withColumn("cz", F.explode(span("lz", "hz")))
    return f.join(s, ["level", "cx", "cz"]).where("cx = greatest(fx, gx) AND cz = greatest(fz, gz) AND minx <= hx AND maxx >= lx AND minz <= hz AND maxz >= lz")


def traces(faces: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """Stretches of segments over faces: tid, face, kind, t0, t1 (places on the segment from 0 to 1), h0, h1.

    segments: tid, sx, sz, ex, ez (whole numbers, start and end apart).  Of a surface, h0
    and h1 are the heights at t0 and t1: each side of the face bounds t from below or above
    by a quotient of whole numbers, and a contact in one point has t0 = t1.  Of a wall
    (kind vertical) and of corners on one line (degenerate), they are the least and the
    greatest height on the stretch.
    """
    both = _met(faces, segments, cell)
    return _surfaces(both.where("det <> 0")).union(_walls(both.where("det = 0")))


def _fixed(rows: DataFrame, **columns) -> DataFrame:
    """rows with columns that are computed once: a generator stands between them and the conditions on them, so they aren't copied into these."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_x")).select(*rows.columns, "_x.*")


def _surfaces(both: DataFrame) -> DataFrame:
    lower, upper, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for i in range(3):
        j = (i + 1) % 3
        side = lambda px, pz, i=i, j=j: F.signum("det") * ((F.col(f"x{j}") - F.col(f"x{i}")) * (F.col(pz) - F.col(f"z{i}")) - (F.col(f"z{j}") - F.col(f"z{i}")) * (F.col(px) - F.col(f"x{i}")))
        at, to = side("sx", "sz"), side("ex", "ez")
        cross = at / F.when(at != to, at - to)
        lower.append(F.when(to > at, cross))
        upper.append(F.when(to < at, cross))
        out = out | ((at == to) & (at < 0))
    cut = _fixed(both.where(~out), t0=F.greatest(*lower), t1=F.least(*upper)).where("t0 <= t1")

    def height(t: str):
        px, pz = F.col("sx") + F.col(t) * (F.col("ex") - F.col("sx")), F.col("sz") + F.col(t) * (F.col("ez") - F.col("sz"))
        u = ((F.col("x1") - px) * (F.col("z2") - pz) - (F.col("x2") - px) * (F.col("z1") - pz)) / F.col("det")
        v = ((F.col("x2") - px) * (F.col("z0") - pz) - (F.col("x0") - px) * (F.col("z2") - pz)) / F.col("det")
        return u * F.col("h0") + v * F.col("h1") + (1 - u - v) * F.col("h2")

    return cut.select("tid", "face", F.lit("surface").alias("kind"), "t0", "t1", height("t0").alias("h0"), height("t1").alias("h1"))


def _walls(both: DataFrame) -> DataFrame:
    """Faces that are a line from above: where the segment meets that line, and the heights there."""
    corner = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"z{i}").alias("z"))
    ends = both.withColumn("a", F.least(*[corner(i) for i in range(3)])).withColumn("b", F.greatest(*[corner(i) for i in range(3)]))
    r = _fixed(ends, vx=F.expr("ex - sx"), vz=F.expr("ez - sz"), dx=F.expr("b.x - a.x"), dz=F.expr("b.z - a.z"), ox=F.expr("a.x - sx"), oz=F.expr("a.z - sz"))
    r = _fixed(r, c=F.expr("vx * dz - vz * dx"), off=F.expr("ox * vz - oz * vx"), vv=F.expr("double(vx * vx + vz * vz)"))
    # crossing lines meet in a point; the same line in a stretch; a point on the segment in itself
    crossing, along = F.expr("c <> 0"), F.expr("c = 0 AND off = 0 AND vv > 0")
    ta, tb = F.expr("(ox * vx + oz * vz) / nullif(vv, 0)"), F.expr("((ox + dx) * vx + (oz + dz) * vz) / nullif(vv, 0)")
    t, s = F.expr("(ox * dz - oz * dx) / double(nullif(c, 0))"), F.expr("off / double(nullif(c, 0))")
    r = _fixed(r.where(crossing | along), ta=F.when(crossing, t).otherwise(ta), tb=F.when(crossing, t).otherwise(tb))
    r = _fixed(r, t0=F.when(crossing, F.col("ta")).otherwise(F.greatest(F.lit(0.0), F.least("ta", "tb"))), t1=F.when(crossing, F.col("ta")).otherwise(F.least(F.lit(1.0), F.greatest("ta", "tb")))).where("t0 <= t1 AND t0 >= 0 AND t1 <= 1")
    place = lambda name: F.when(crossing, s).when(F.expr("dx = 0 AND dz = 0"), 0.0).otherwise((F.col(name) - F.col("ta")) / F.nullif(F.col("tb") - F.col("ta"), F.lit(0.0)))
    r = _fixed(r, p=place("t0"), q=place("t1"))
    r = _fixed(r, s0=F.least("p", "q"), s1=F.greatest("p", "q")).where("s0 >= 0 AND s1 <= 1")
    places = [F.when(F.col("dx") != 0, (F.col(f"x{i}") - F.col("a.x")) / F.nullif(F.col("dx"), F.lit(0).cast("long"))).when(F.col("dz") != 0, (F.col(f"z{i}") - F.col("a.z")) / F.nullif(F.col("dz"), F.lit(0).cast("long"))).otherwise(0.0) for i in range(3)]
    r = _fixed(r, **{f"at{i}": a for i, a in enumerate(places)})
    at, h = [F.col(f"at{i}") for i in range(3)], [F.col(f"h{i}").cast("double") for i in range(3)]
    found = [F.when((at[i] >= F.col("s0") - 1e-12) & (at[i] <= F.col("s1") + 1e-12), h[i]) for i in range(3)]
    for i, j in ((0, 1), (1, 2), (2, 0)):
        for end in ("s0", "s1"):
            between = (F.least(at[i], at[j]) < F.col(end)) & (F.col(end) < F.greatest(at[i], at[j]))
            found.append(F.when(between, h[i] + (h[j] - h[i]) * (F.col(end) - at[i]) / F.nullif(at[j] - at[i], F.lit(0.0))))
    kind = F.when(F.col("degenerate_3d"), "degenerate").otherwise("vertical")
    return r.select("tid", "face", kind.alias("kind"), "t0", "t1", F.least(*found).alias("h0"), F.greatest(*found).alias("h1"))


def coverage(found: DataFrame) -> DataFrame:
    """tid, covered (share of the segment over any surface), gaps (stretches without a surface inside it, the ends included); walls cover nothing."""
    found = found.where("kind = 'surface'")
    w = Window.partitionBy("tid").orderBy("t0", "t1")
    rows = found.select("tid", "t0", "t1", F.coalesce(F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    eps = 1e-9
    return rows.groupBy("tid").agg(
        F.sum(F.greatest(F.lit(0.0), F.col("t1") - F.greatest("t0", "before"))).alias("covered"),
        (F.count_if(F.col("t0") > F.col("before") + eps) + F.max("t1").__lt__(1 - eps).cast("long")).alias("gaps"),
    )
