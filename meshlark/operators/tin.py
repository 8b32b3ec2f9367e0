"""Metrics of triangles with whole-number corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOPE_BINS = (5, 15, 30, 45, 60, 75)


def determinant() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("z2") - F.col("z0")) - (F.col("x2") - F.col("x0")) * (F.col("z1") - F.col("z0"))


def metrics(faces: DataFrame) -> DataFrame:
    """faces with det (doubled signed area), area2, zero_xz, degenerate_3d, bounds."""
    d = lambda a, i: F.col(f"{a}{i}") - F.col(f"{a}0")
    flat = (d("z", 1) * d("h", 2) - d("h", 1) * d("z", 2) == 0) & (d("h", 1) * d("x", 2) - d("x", 1) * d("h", 2) == 0) & (determinant() == 0)
    low, high = (lambda a: F.least(*[F.col(f"{a}{i}") for i in range(3)])), (lambda a: F.greatest(*[F.col(f"{a}{i}") for i in range(3)]))
    return faces.withColumns({"det": determinant(), "area2": F.abs(determinant()), "zero_xz": determinant() == 0, "degenerate_3d": flat, "minx": low("x"), "maxx": high("x"), "minz": low("z"), "maxz": high("z"), "minh": low("h"), "maxh": high("h")})


def slope_aspect(faces: DataFrame) -> DataFrame:
    """faces with slope (degrees), aspect (degrees clockwise from north, null if flat) and aspect_class; null where the plane is undefined."""
    d = lambda a, i: (F.col(f"{a}{i}") - F.col(f"{a}0")).cast("double")
    det = d("x", 1) * d("z", 2) - d("x", 2) * d("z", 1)
    sides = F.sqrt(d("x", 1) ** 2 + d("z", 1) ** 2) * F.sqrt(d("x", 2) ** 2 + d("z", 2) ** 2)
    defined = F.abs(det) > 1e-10 * F.greatest(F.lit(1.0), sides)
    east = F.when(defined, F.try_divide(d("h", 1) * d("z", 2) - d("h", 2) * d("z", 1), det))
    south = F.when(defined, F.try_divide(d("x", 1) * d("h", 2) - d("x", 2) * d("h", 1), det))
    rows = faces.withColumns({"east": east, "south": south})
    g = F.sqrt(F.col("east") ** 2 + F.col("south") ** 2)
    aspect = F.when(g >= 1e-8, (F.atan2(-F.col("east"), F.col("south")) * 180 / F.pi() + 360) % 360)
    rows = rows.withColumns({"slope": F.atan(g) * 180 / F.pi(), "aspect": aspect})
    return rows.withColumn("aspect_class", F.floor(((F.col("aspect") + 22.5) % 360) / 45).cast("int"))


def slope_bin() -> Column:
    out = F.when(F.col("slope").isNull(), None)
    for i, end in enumerate(SLOPE_BINS):
        out = out.when(F.col("slope") < end, i)
    return out.otherwise(len(SLOPE_BINS))


def corner_key() -> Column:
    """The corners without their order: equal for duplicate faces."""
    return F.array_sort(F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"z{i}").alias("z"), F.col(f"h{i}").alias("h")) for i in range(3)]))


def duplicates(faces: DataFrame) -> DataFrame:
    """Groups of faces with the same corners: leader (smallest id), members, excess."""
    return faces.select("face", corner_key().alias("k")).groupBy("k").agg(F.min("face").alias("leader"), F.count("*").alias("members")).where("members > 1").select("leader", "members", (F.col("members") - 1).alias("excess"))


def with_duplicates(faces: DataFrame) -> DataFrame:
    """faces with dup_count; one shuffle on the corners, counted on the map side first."""
    keyed = faces.withColumn("k", corner_key())
    counts = keyed.groupBy("k").agg(F.count("*").alias("dup_count"))
    return keyed.join(counts, "k").drop("k").hint("merge")


def cross_tab(faces: DataFrame) -> DataFrame:
    """Region by terrain with both margins and the total: one pass with grouping sets."""
    rows = slope_aspect(metrics(with_duplicates(faces))).withColumn("bin", slope_bin())
    area = F.col("area2")
    sums = [
        F.count("*").alias("faces"), F.sum("area2").alias("area2"), F.count_if("zero_xz").alias("zero_xz"), F.count_if(F.col("dup_count") > 1).alias("duplicate_members"), F.min("minh").alias("y_min"), F.max("maxh").alias("y_max"),
        F.count("slope").alias("slope_faces"), F.sum(F.when(F.col("slope").isNotNull(), area).otherwise(0)).alias("slope_area2"), F.round(F.sum(area * F.col("slope")) / F.sum(F.when(F.col("slope").isNotNull(), area)), 6).alias("slope_mean"),
        F.count_if(F.col("slope").isNotNull() & F.col("aspect").isNull()).alias("flat_faces"),
        *[F.sum(F.when(F.col("bin") == b, area).otherwise(0)).alias(f"slope_bin{b}") for b in range(7)],
        *[F.sum(F.when(F.col("aspect_class") == a, area).otherwise(0)).alias(f"aspect{a}") for a in range(8)],
    ]
    return rows.groupingSets([["region", "terrain"], ["region"], ["terrain"], []], "region", "terrain").agg(*sums)


def shares(faces: DataFrame) -> DataFrame:
    """Each cell's share of its region's faces and area, in percent (null for an empty whole)."""
    cells = metrics(faces).groupBy("region", "terrain").agg(F.count("*").alias("faces"), F.sum("area2").alias("area2"))
    whole = cells.groupBy("region").agg(F.sum("faces").alias("all_faces"), F.sum("area2").alias("all_area2"))
    share = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 6)
    return cells.join(F.broadcast(whole), "region").select("region", "terrain", "faces", share("faces", "all_faces").alias("count_percent"), share("area2", "all_area2").alias("area_percent"))  # one row per region


def representative(faces: DataFrame) -> DataFrame:
    """Of each region the face of the largest area, then of the smallest id."""
    return metrics(faces).groupBy("region").agg(F.max_by("face", F.struct("area2", -F.col("face"))).alias("face"), F.max("area2").alias("area2"))


def in_cells(rows: DataFrame, cell: int) -> DataFrame:
    """Rows with bounds minx, maxx, minz, maxz in the cells (level, cx, cz) they touch.

    A level's cells are twice as wide as those of the level below; a row lies in the first
    level where it touches four cells at most, so a huge face is no more rows than a small one.
    """
    wide = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxz") - F.col("minz"), F.lit(1)).cast("double")
    rows = rows.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(wide / cell))).cast("int"))
    size = cell * F.pow(F.lit(2.0), F.col("level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return rows.withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cz", F.explode(span("minz", "maxz")))


def levels_of(rows: DataFrame) -> list[int]:
    """The levels there are: a few dozen numbers at most, as sizes double."""
    return sorted(r["level"] for r in rows.select("level").distinct().collect())


def surfaces_at(faces: DataFrame, points: DataFrame, cell: int = 100) -> DataFrame:
    """All surfaces over points (px / q, pz / q) with whole px, pz, q > 0: face, kind, and the exact heights low_n / low_d to high_n / high_d.

    kind: inside or boundary (one height); vertical (a wall that the line runs in) and
    degenerate (corners on one line), with the interval of their heights there.  Faces and
    points meet in the cells of a grid, so the join is on cells, not on all pairs; exact
    predicates on whole numbers decide.
    """
    cells = in_cells(metrics(faces), cell)
    levels = levels_of(cells)
    if not levels:
        return faces.sparkSession.createDataFrame([], "qid long, face long, kind string, low_n long, low_d long, high_n long, high_d long")
    at = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    size = cell * F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumns({"cx": F.floor(F.col("px") / F.col("q") / size), "cz": F.floor(F.col("pz") / F.col("q") / size)})

    def turn(i: int, j: int) -> Column:
        """Twice the signed area of corner i, corner j and the point, times q."""
        return (F.col(f"x{j}") - F.col(f"x{i}")) * (F.col("pz") - F.col(f"z{i}") * F.col("q")) - (F.col(f"z{j}") - F.col(f"z{i}")) * (F.col("px") - F.col(f"x{i}") * F.col("q"))

    sign = F.when(F.col("det") < 0, -1).otherwise(1)
    # points stream past the faces of their cell, which a sort-merge join holds in memory
    met = at.join(cells, ["level", "cx", "cz"]).where("px BETWEEN minx * q AND maxx * q AND pz BETWEEN minz * q AND maxz * q")
    met = met.withColumns({f"w{k}": turn((k + 1) % 3, (k + 2) % 3) * sign for k in range(3)}).where("w0 >= 0 AND w1 >= 0 AND w2 >= 0 AND (det <> 0 OR w0 = 0 AND w1 = 0 AND w2 = 0)")
    n, d = F.col("w0") * F.col("h0") + F.col("w1") * F.col("h1") + F.col("w2") * F.col("h2"), F.col("area2") * F.col("q")
    kind = F.when(F.col("det") == 0, F.when(F.col("degenerate_3d"), "degenerate").otherwise("vertical")).when(F.least("w0", "w1", "w2") == 0, "boundary").otherwise("inside")
    met = met.select("qid", "face", kind.alias("kind"), F.when(F.col("det") != 0, _reduced(n, d, "long")).alias("one"), F.when(F.col("det") == 0, _wall()).alias("h"))
    # one height for a surface, an interval for the few others
    low = F.when(F.col("h").isNull(), F.col("one")).otherwise(_reduced(F.col("h.low"), F.col("h.d")))
    high = F.when(F.col("h").isNull(), F.col("one")).otherwise(_reduced(F.col("h.high"), F.col("h.d")))
    return met.select("qid", "face", "kind", low.alias("l"), high.alias("u")).select("qid", "face", "kind", F.col("l.n").alias("low_n"), F.col("l.d").alias("low_d"), F.col("u.n").alias("high_n"), F.col("u.d").alias("high_d"))


def _wall() -> Column:
    """Heights, over one denominator, where the line through a point meets a face whose projection is a segment that holds the point."""
    big = lambda c: c.cast("decimal(38,0)")
    upright = (F.col("x0") == F.col("x1")) & (F.col("x1") == F.col("x2"))
    u = [F.when(upright, F.col(f"z{i}")).otherwise(F.col(f"x{i}")) for i in range(3)]
    p = F.when(upright, F.col("pz")).otherwise(F.col("px"))
    q, h = F.col("q"), [F.col(f"h{i}") for i in range(3)]
    sides = [(0, 1), (1, 2), (2, 0)]
    length = {e: F.greatest(F.lit(1), F.abs(u[e[1]] - u[e[0]])) for e in sides}
    whole = big(q) * big(length[0, 1]) * big(length[1, 2]) * big(length[2, 0])
    found = [F.when(u[i] * q == p, big(h[i]) * whole) for i in range(3)]
    for i, j in sides:
        between = (F.least(u[i], u[j]) * q < p) & (p < F.greatest(u[i], u[j]) * q)
        rest = [length[e] for e in sides if e != (i, j)]
        # height times q times the side's length, whatever way the side runs
        value = big(h[i]) * big(q) * big(length[i, j]) + big(h[j] - h[i]) * big((p - u[i] * q) * F.when(u[j] < u[i], -1).otherwise(1))
        found.append(F.when(between, value * big(rest[0]) * big(rest[1])))
    return F.struct(F.least(*found).alias("low"), F.greatest(*found).alias("high"), whole.alias("d"))


def _reduced(n: Column, d: Column, kind: str = "decimal(38,0)") -> Column:
    """n / d > 0 in lowest terms, by as many steps of Euclid's algorithm as the denominator can need, in numbers of a kind."""
    one = F.array(F.struct(n.cast(kind).alias("n"), d.cast(kind).alias("d")))

    def of(x: Column) -> Column:
        step = F.struct(F.abs(x["n"]).alias("a"), x["d"].alias("b"))
        most = F.ceil(1.45 * F.log2(x["d"].cast("double"))).cast("int") + 3
        g = F.aggregate(F.sequence(F.lit(1), most), step, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(kind).alias("b"))), lambda s: s["a"])
        share = (lambda v: F.call_function("div", v, g)) if kind == "long" else (lambda v: (v / g).cast("long"))
        return F.struct(share(x["n"]).alias("n"), share(x["d"]).alias("d"))

    return F.element_at(F.transform(one, of), 1)


def rational(text: Column) -> Column:
    """A whole number, fraction, decimal or number with an exponent as n / d in lowest terms.

    Null for any other text, one of more than 80 characters, a zero denominator, more
    than 30 digits, and values beyond a million to either side.
    """
    ten = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("decimal(38,0)")
    whole = lambda c: c.cast("decimal(38,0)")
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    ratio, number = r"^([+-]?[0-9]{1,30})/([0-9]{1,30})$", r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,2}))?$"
    digits = F.concat(part(number, 2), part(number, 3))
    shift = F.coalesce(F.when(part(number, 4) != "", part(number, 4)).cast("int"), F.lit(0)) - F.length(part(number, 3))
    sign = F.when(part(number, 1) == "-", -1).otherwise(1)
    pair = lambda n, d: F.struct(n.cast("decimal(38,0)").alias("n"), d.cast("decimal(38,0)").alias("d"))
    plain = pair(whole(digits) * sign * ten(F.greatest(shift, F.lit(0))), ten(F.greatest(-shift, F.lit(0))))
    found = F.when(text.rlike(ratio), F.when(whole(part(ratio, 2)) != 0, pair(whole(part(ratio, 1)), whole(part(ratio, 2))))).when(text.rlike(number) & F.length(digits).between(1, 30) & F.abs(shift).between(0, 30), plain)
    found = F.when(F.length(text) <= 80, found)
    # the value must fit: |n| <= 1e6 d
    fits = lambda x: F.when(x.isNotNull() & (F.abs(x["n"]).cast("double") <= 1e6 * x["d"].cast("double")), _reduced(x["n"], x["d"]))
    return F.element_at(F.transform(F.array(found), fits), 1)


def clipped(ring: Column, axis: str, limit: Column) -> Column:
    """The part of a ring of points (x, z, h) up to a limit along an axis, with heights along the cut.

    A ring inside the limit is returned as it is; equal neighbours that a cut makes are one.
    """
    inside = lambda p: p[axis] <= limit

    def side(i: Column) -> Column:
        b = F.get(ring, i)
        a = F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
        t = (limit - a[axis]) / F.when(b[axis] != a[axis], b[axis] - a[axis])
        cut = F.struct(*[(limit if f == axis else a[f] + t * (b[f] - a[f])).alias(f) for f in "xzh"])
        return F.concat(F.when(inside(a) != inside(b), F.array(cut)).otherwise(F.array().cast("array<struct<x:double,z:double,h:double>>")), F.when(inside(b), F.array(F.struct(*[b[f].alias(f) for f in "xzh"]))).otherwise(F.array().cast("array<struct<x:double,z:double,h:double>>")))

    made = F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), side))
    once = lambda c: F.filter(c, lambda p, i: (i == 0) | (p != F.get(c, i - 1)))
    open_ = lambda c: F.when((F.size(c) > 1) & (F.get(c, F.lit(0)) == F.get(c, F.size(c) - 1)), F.slice(c, 1, F.size(c) - 1)).otherwise(c)
    cleaned = F.element_at(F.transform(F.transform(F.array(made), once), open_), 1)
    return F.when(F.forall(ring, inside), ring).otherwise(cleaned)


def ring_area(name: str) -> Column:
    """Signed area of a ring of points over x and z."""
    turn = "aggregate(sequence(0, size({0}) - 1), 0D, (s, i) -> s + get({0}, i).x * get({0}, (i + 1) % size({0})).z - get({0}, (i + 1) % size({0})).x * get({0}, i).z) / 2"
    return F.expr(turn.format(name))
