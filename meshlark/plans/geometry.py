"""Queries over the sphere and along lines: coordinates, measures, projections backwards, transects."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.functions import sphere
from meshlark.operators import transect
from meshlark.plans.catalog import _PLACES, FACES, _places, query
from meshlark.sources.tables import CELL, WIDTH, faces, table

HEIGHT = 4000


@query(FACES + """, c AS (SELECT face, x0, z0, x0 / 5000.0 * 360 - 180 AS l, degrees(atan((exp(pi() * (1 - 2 * z0 / 4000.0)) - exp(-pi() * (1 - 2 * z0 / 4000.0))) / 2)) AS lat FROM faces)
SELECT face, round(fmod(fmod(l + 180, 360) + 360, 360) - 180, 9) AS lon, round(lat, 9) AS lat, CAST(x0 % 5000 AS BIGINT) AS x, CAST(z0 AS BIGINT) AS z FROM c""")
def f40_geographic(spark, d):
    """First corners as longitude and latitude, and back as whole numbers."""
    lon, lat = sphere.to_geographic(F.col("x0"), F.col("z0"), WIDTH, HEIGHT)
    f = faces(spark, d).select("face", lon.alias("lon"), lat.alias("lat"), sphere.isometric_latitude(F.col("z0"), HEIGHT).alias("isometric"))
    x, z = sphere.from_geographic(F.col("lon"), F.col("lat"), WIDTH, HEIGHT, F.col("isometric"))
    return f.select("face", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round(x).cast("long").alias("x"), F.round(z).cast("long").alias("z"))


_STEPS = _PLACES + """, n AS (SELECT s_nationkey, s_suppkey, lon, lat, x, y, z, lead(s_suppkey) OVER w AS t, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM v WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))"""


def _steps(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return _places(spark, d).select("*", *[F.lead(c).over(w).alias(c + "2") for c in ("lon", "lat")]).where("lon2 IS NOT NULL")


@query(_STEPS + """ SELECT s_nationkey, count(*) AS steps, round(sum(2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2))))), 3) AS length FROM n WHERE t IS NOT NULL GROUP BY s_nationkey""")
def f44_path_length(spark, d):
    """Length of the way through each nation's places."""
    c = [F.col(n) for n in ("lon", "lat", "lon2", "lat2")]
    return _steps(spark, d).groupBy("s_nationkey").agg(F.count("*").alias("steps"), F.round(F.sum(sphere.haversine(*c)), 3).alias("length"))


@query(_STEPS + """, a AS (SELECT *, acos(greatest(-1, least(1, x * x2 + y * y2 + z * z2))) AS w FROM n WHERE t IS NOT NULL), m AS (SELECT *, greatest(1, least(3600, CAST(ceil(round(degrees(w) / 20, 9)) AS INTEGER))) AS k FROM a WHERE w > 1e-6 AND w < pi() - 1e-6), s AS (SELECT *, unnest(range(0, k + 1)) AS i FROM m),
q AS (SELECT s_suppkey, i, (sin((1 - i / CAST(k AS DOUBLE)) * w) * x + sin(i / CAST(k AS DOUBLE) * w) * x2) / sin(w) AS a, (sin((1 - i / CAST(k AS DOUBLE)) * w) * y + sin(i / CAST(k AS DOUBLE) * w) * y2) / sin(w) AS b, (sin((1 - i / CAST(k AS DOUBLE)) * w) * z + sin(i / CAST(k AS DOUBLE) * w) * z2) / sin(w) AS c FROM s)
SELECT s_suppkey, CAST(i AS INTEGER) AS i, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(c, 5) + 0.0 AS c FROM q""")
def f45_great_circle(spark, d):
    """Points at most twenty degrees apart between neighbouring places."""
    c = [F.col(n) for n in ("lon", "lat", "lon2", "lat2")]
    w = sphere.central_angle(*c)
    rows = _steps(spark, d).where((w > 1e-6) & (w < 3.141592653589793 - 1e-6)).select("s_suppkey", F.explode(sphere.samples(*c, 20.0)).alias("p")).select("s_suppkey", "p.*")
    v = sphere.vector(F.col("lon"), F.col("lat"))
    return rows.select("s_suppkey", "i", *[(F.round(x, 5) + 0.0).alias(n) for n, x in zip("abc", v, strict=True)])


@query(FACES + """, g AS (SELECT face, [x0, x1, x2] AS xs, [z0, z1, z2] AS zs FROM faces WHERE det <> 0), u AS (SELECT face, list_transform(range(1, 4), lambda i: radians(xs[i] / 5000.0 * 360 - 180)) AS l, list_transform(range(1, 4), lambda i: radians(80 - zs[i] / 100.0)) AS p FROM g),
v AS (SELECT face, cos(p[1]) * cos(l[1]) AS ax, cos(p[1]) * sin(l[1]) AS ay, sin(p[1]) AS az, cos(p[2]) * cos(l[2]) AS bx, cos(p[2]) * sin(l[2]) AS by_, sin(p[2]) AS bz, cos(p[3]) * cos(l[3]) AS cx, cos(p[3]) * sin(l[3]) AS cy, sin(p[3]) AS cz FROM u)
SELECT face, round(2 * atan2(abs(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)), 1 + ax * bx + ay * by_ + az * bz + bx * cx + by_ * cy + bz * cz + cx * ax + cy * ay + cz * az) * 1000000, 4) AS area FROM v""")
def f46_sphere_area(spark, d):
    """Areas of the faces on a sphere of radius 1,000."""
    at = [sphere.vector(F.col(f"x{i}") / 5000.0 * 360 - 180, 80 - F.col(f"z{i}") / 100.0) for i in range(3)]
    flat = "(x1 - x0) * (z2 - z0) - (x2 - x0) * (z1 - z0) <> 0"
    return faces(spark, d).where(flat).select("face", F.round(sphere.triangle_area(*at, radius=1000.0), 4).alias("area"))


@query(_PLACES + " SELECT s_suppkey, projection, round(area, 3) AS area, round(largest, 3) AS largest, round(smallest, 3) AS smallest FROM (SELECT s_suppkey, 'mercator' AS projection, 1 / power(cos(radians(lat)), 2) AS area, 1 / cos(radians(lat)) AS largest, 1 / cos(radians(lat)) AS smallest FROM p WHERE abs(lat) <= 60 UNION ALL SELECT s_suppkey, 'gall-peters', 1, greatest(1 / (sqrt(2) * cos(radians(lat))), sqrt(2) * cos(radians(lat))), least(1 / (sqrt(2) * cos(radians(lat))), sqrt(2) * cos(radians(lat))) FROM p WHERE abs(lat) <= 60)")
def f53_distortion(spark, d):
    """Scales of two projections whose scales are known (also F55: half axes of the ellipses)."""
    lon, lat = F.col("lon"), F.col("lat")
    each = F.array(*[F.struct(F.lit(n).alias("projection"), *[F.round(v, 3).alias(k) for k, v in sphere.distortion(n, lon, lat).items() if k != "deformation"]) for n in ("mercator", "gall-peters")])
    return _places(spark, d).where("abs(lat) <= 60").select("s_suppkey", F.explode(each).alias("e")).select("s_suppkey", "e.*")


@query(_PLACES + " SELECT s_suppkey, projection, round(lon, 4) AS lon, round(lat, 4) AS lat FROM p, (VALUES ('equal-earth'), ('natural-earth'), ('winkel-tripel')) v(projection) WHERE abs(lat) <= 70 AND abs(lon) <= 160")
def f54_inverse_projection(spark, d):
    """Places projected and solved back by Newton steps."""
    names = ("equal-earth", "natural-earth", "winkel-tripel")
    own = _places(spark, d).where("abs(lat) <= 70 AND abs(lon) <= 160")
    one = lambda n: own.select("s_suppkey", *[v.alias(a) for a, v in zip("xy", sphere.project(n, F.col("lon"), F.col("lat")), strict=True)]).select("s_suppkey", F.lit(n).alias("projection"), *[F.round(v, 4).alias(a) for a, v in zip(("lon", "lat"), sphere.solved(n, F.col("x"), F.col("y")), strict=True)])
    return one(names[0]).union(one(names[1])).union(one(names[2]))


@query(_STEPS + """, c AS (SELECT s_suppkey, lon, lat, lon2, lat2, CASE WHEN abs(lon2 - lon) <= 180 THEN 0 WHEN lon2 < lon THEN 1 ELSE -1 END AS over FROM n WHERE t IS NOT NULL)
SELECT s_suppkey, CASE WHEN over = 0 THEN 1 ELSE 2 END AS parts, round(CASE WHEN over <> 0 THEN lat + (180 * over - lon) / (lon2 - lon + 360 * over) * (lat2 - lat) END, 6) AS seam_lat FROM c""")
def f49_antimeridian(spark, d):
    """Steps between places, split where they go over the antimeridian."""
    point = lambda a, b: F.struct(F.col(a).alias("lon"), F.col(b).alias("lat"))
    s = _steps(spark, d).select("s_suppkey", sphere.split_at_antimeridian(F.array(point("lon", "lat"), point("lon2", "lat2"))).alias("parts"))
    return s.select("s_suppkey", F.size("parts").alias("parts"), F.round(F.when(F.size("parts") > 1, F.element_at(F.element_at("parts", 1), -1)["lat"]), 6).alias("seam_lat"))


_TRACES = FACES + """, seg AS (SELECT o_orderkey AS tid, (o_custkey * 37) % 4800 AS sx, (o_orderkey * 53) % 3800 AS sz, (o_custkey * 37) % 4800 + 60 + o_orderkey % 90 AS ex, (o_orderkey * 53) % 3800 + o_custkey % 130 AS ez FROM orders),
pair AS (SELECT tid, face, sign(det) AS sg, det, x0, z0, h0, x1, z1, h1, x2, z2, h2, sx, sz, ex, ez FROM seg JOIN faces ON det <> 0 AND least(x0, x1, x2) <= ex AND greatest(x0, x1, x2) >= sx AND least(z0, z1, z2) <= ez AND greatest(z0, z1, z2) >= sz),
w AS (SELECT *, sg * ((x1 - x0) * (sz - z0) - (z1 - z0) * (sx - x0)) AS a0, sg * ((x1 - x0) * (ez - z0) - (z1 - z0) * (ex - x0)) AS b0, sg * ((x2 - x1) * (sz - z1) - (z2 - z1) * (sx - x1)) AS a1, sg * ((x2 - x1) * (ez - z1) - (z2 - z1) * (ex - x1)) AS b1, sg * ((x0 - x2) * (sz - z2) - (z0 - z2) * (sx - x2)) AS a2, sg * ((x0 - x2) * (ez - z2) - (z0 - z2) * (ex - x2)) AS b2 FROM pair),
t AS (SELECT *, greatest(0, CASE WHEN b0 > a0 THEN a0 / CAST(a0 - b0 AS DOUBLE) END, CASE WHEN b1 > a1 THEN a1 / CAST(a1 - b1 AS DOUBLE) END, CASE WHEN b2 > a2 THEN a2 / CAST(a2 - b2 AS DOUBLE) END) AS t0, least(1, CASE WHEN b0 < a0 THEN a0 / CAST(a0 - b0 AS DOUBLE) END, CASE WHEN b1 < a1 THEN a1 / CAST(a1 - b1 AS DOUBLE) END, CASE WHEN b2 < a2 THEN a2 / CAST(a2 - b2 AS DOUBLE) END) AS t1 FROM w WHERE NOT ((a0 = b0 AND a0 < 0) OR (a1 = b1 AND a1 < 0) OR (a2 = b2 AND a2 < 0))),
trace AS (SELECT * FROM t WHERE t0 <= t1)"""


def _segments(spark, d):
    sx, sz = (F.col("o_custkey") * 37) % 4800, (F.col("o_orderkey") * 53) % 3800
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), sx.alias("sx"), sz.alias("sz"), (sx + 60 + F.col("o_orderkey") % 90).alias("ex"), (sz + F.col("o_custkey") % 130).alias("ez"))


_WALLS = _TRACES + """, wl AS (SELECT tid, face, least((x0, z0), (x1, z1), (x2, z2)) AS a, greatest((x0, z0), (x1, z1), (x2, z2)) AS b, [x0, x1, x2] AS xs, [z0, z1, z2] AS zs, [h0, h1, h2] AS hs, sx, sz, ex - sx AS vx, ez - sz AS vz, (z1 - z0) * (h2 - h0) = (h1 - h0) * (z2 - z0) AND (h1 - h0) * (x2 - x0) = (x1 - x0) * (h2 - h0) AS flat
  FROM seg JOIN faces ON det = 0 AND least(x0, x1, x2) <= ex AND greatest(x0, x1, x2) >= sx AND least(z0, z1, z2) <= ez AND greatest(z0, z1, z2) >= sz),
wd AS (SELECT *, b[1] - a[1] AS dx, b[2] - a[2] AS dz, a[1] - sx AS ox, a[2] - sz AS oz FROM wl), wc AS (SELECT *, vx * dz - vz * dx AS c, ox * vz - oz * vx AS off, CAST(vx * vx + vz * vz AS DOUBLE) AS vv FROM wd),
wt AS (SELECT *, (ox * dz - oz * dx) / CAST(c AS DOUBLE) AS t0, (ox * dz - oz * dx) / CAST(c AS DOUBLE) AS t1, off / CAST(c AS DOUBLE) AS s0, off / CAST(c AS DOUBLE) AS s1 FROM wc WHERE c <> 0
  UNION ALL SELECT * EXCLUDE (ta, tb), CASE WHEN dx = 0 AND dz = 0 THEN 0 ELSE least((t0 - ta) / (tb - ta), (t1 - ta) / (tb - ta)) END, CASE WHEN dx = 0 AND dz = 0 THEN 0 ELSE greatest((t0 - ta) / (tb - ta), (t1 - ta) / (tb - ta)) END FROM (SELECT * EXCLUDE (ta, tb), greatest(0, least(ta, tb)) AS t0, least(1, greatest(ta, tb)) AS t1, ta, tb FROM (SELECT *, (ox * vx + oz * vz) / vv AS ta, ((ox + dx) * vx + (oz + dz) * vz) / vv AS tb FROM wc WHERE c = 0 AND off = 0 AND vv > 0))),
wg AS (SELECT *, list_transform([1, 2, 3], lambda i: CASE WHEN dx <> 0 THEN (xs[i] - a[1]) / CAST(dx AS DOUBLE) WHEN dz <> 0 THEN (zs[i] - a[2]) / CAST(dz AS DOUBLE) ELSE 0.0 END) AS p FROM wt WHERE t0 <= t1 AND t0 >= 0 AND t1 <= 1 AND s0 >= 0 AND s1 <= 1),
we AS (SELECT tid, face, unnest([1, 2, 3]) AS i FROM wg), wh AS (SELECT wg.tid, wg.face, hs[i] + 0.0 AS h FROM wg JOIN we USING (tid, face) WHERE p[i] >= s0 - 1e-12 AND p[i] <= s1 + 1e-12
  UNION ALL SELECT wg.tid, wg.face, hs[i] + (hs[i % 3 + 1] - hs[i]) * (s0 - p[i]) / (p[i % 3 + 1] - p[i]) FROM wg JOIN we USING (tid, face) WHERE least(p[i], p[i % 3 + 1]) < s0 AND s0 < greatest(p[i], p[i % 3 + 1])
  UNION ALL SELECT wg.tid, wg.face, hs[i] + (hs[i % 3 + 1] - hs[i]) * (s1 - p[i]) / (p[i % 3 + 1] - p[i]) FROM wg JOIN we USING (tid, face) WHERE least(p[i], p[i % 3 + 1]) < s1 AND s1 < greatest(p[i], p[i % 3 + 1])),
wm AS (SELECT tid, face, min(h) AS low, max(h) AS high FROM wh GROUP BY ALL)"""


@query(_WALLS + """ SELECT tid, face, 'surface' AS kind, round(t0, 8) AS t0, round(t1, 8) AS t1, round(h0 + ((sx + t0 * (ex - sx) - x0) * ((h1 - h0) * (z2 - z0) - (h2 - h0) * (z1 - z0)) + (sz + t0 * (ez - sz) - z0) * ((x1 - x0) * (h2 - h0) - (x2 - x0) * (h1 - h0))) / CAST(det AS DOUBLE) + 2e-7, 5) + 0.0 AS height, -1.0 AS top FROM trace
UNION ALL SELECT tid, face, CASE WHEN flat THEN 'degenerate' ELSE 'vertical' END, round(t0, 8) + 0.0, round(t1, 8) + 0.0, round(low + 2e-7, 5) + 0.0, round(high + 2e-7, 5) FROM wg JOIN wm USING (tid, face)""")
def j8_transects(spark, d):
    """All stretches of faces along segments: surfaces with the height where each begins, walls with their least and greatest.

    Heights are often halves of the last digit, hence the small shift before rounding.
    """
    rows = transect.traces(faces(spark, d), _segments(spark, d), 2 * CELL)
    top = F.when(F.col("kind") == "surface", -1.0).otherwise(F.round(F.col("h1") + 2e-7, 5))
    return rows.select("tid", "face", "kind", (F.round("t0", 8) + 0.0).alias("t0"), (F.round("t1", 8) + 0.0).alias("t1"), (F.round(F.col("h0") + 2e-7, 5) + 0.0).alias("height"), top.alias("top"))


@query(_TRACES + """, o AS (SELECT tid, t0, t1, coalesce(max(t1) OVER (PARTITION BY tid ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM trace)
SELECT tid, round(sum(greatest(0, t1 - greatest(t0, b))), 7) AS covered, count(*) FILTER (t0 > b + 1e-9) + CASE WHEN max(t1) < 1 - 1e-9 THEN 1 ELSE 0 END AS gaps FROM o GROUP BY tid""")
def v7_transect_coverage(spark, d):
    """Share of each segment over any surface, and the gaps."""
    return transect.coverage(transect.traces(faces(spark, d), _segments(spark, d), 2 * CELL)).select("tid", F.round("covered", 7).alias("covered"), "gaps")
