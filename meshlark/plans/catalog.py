"""Queries over the tables, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.functions import search, sphere
from meshlark.operators import graph, multiset, ordered, tin, topology
from meshlark.sources.tables import WIDTH, faces, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The surface of sources.tables.faces, written for DuckDB.
FACES = """
WITH cell AS (SELECT p_partkey AS k, CAST(p_size % 32 AS INTEGER) AS terrain, p_partkey % 50 AS c, p_partkey // 50 AS r FROM part),
grid AS (SELECT k, terrain, c, r, (37 * (c % 50) + 91 * r + 13 * (c % 50) * r) % 64 AS h00, (37 * ((c + 1) % 50) + 91 * r + 13 * ((c + 1) % 50) * r) % 64 AS h10,
  (37 * (c % 50) + 91 * (r + 1) + 13 * (c % 50) * (r + 1)) % 64 AS h01, (37 * ((c + 1) % 50) + 91 * (r + 1) + 13 * ((c + 1) % 50) * (r + 1)) % 64 AS h11 FROM cell),
made AS (
  SELECT 2 * k AS face, k, c, r, terrain, 100 * c AS x0, 100 * r AS z0, h00 AS h0, 100 * c + 100 AS x1, 100 * r AS z1, h10 AS h1, 100 * c AS x2, 100 * r + 100 AS z2, h01 AS h2 FROM grid
  UNION ALL SELECT 2 * k + 1, k, c, r, terrain, 100 * c + 100, 100 * r, h10, 100 * c + 100, 100 * r + 100, h11, 100 * c, 100 * r + 100, h01 FROM grid
  UNION ALL SELECT 1000000000 + 2 * k, k, c, r, terrain, 100 * c, 100 * r, h00, 100 * c + 100, 100 * r, h10, 100 * c, 100 * r + 100, h01 FROM grid WHERE k % 101 = 0
  UNION ALL SELECT 2000000000 + 2 * k, k, c, r, terrain, 100 * c, 100 * r, 0, 100 * c, 100 * r, 50, 100 * c, 100 * r + 100, 25 FROM grid WHERE k % 103 = 0
  UNION ALL SELECT 3000000000 + 2 * k, k, c, r, terrain, 100 * c, 100 * r, h00, 100 * c, 100 * r, h00, 100 * c + 100, 100 * r, h10 FROM grid WHERE k % 107 = 0),
faces AS (SELECT face, x0, z0, h0, x1, z1, h1, x2, z2, h2, terrain, CAST(r % 18 AS INTEGER) AS region, CASE WHEN k % 97 = 0 THEN 3 ELSE 0 END AS script, k % 11 = 0 AS chocobo,
  (x1 - x0) * (z2 - z0) - (x2 - x0) * (z1 - z0) AS det FROM made)"""

#: Slope and aspect of each face.
SLOPES = FACES + """,
plane AS (SELECT *, CASE WHEN det <> 0 THEN ((h1 - h0) * (z2 - z0) - (h2 - h0) * (z1 - z0)) / CAST(det AS DOUBLE) END AS east,
  CASE WHEN det <> 0 THEN ((x1 - x0) * (h2 - h0) - (x2 - x0) * (h1 - h0)) / CAST(det AS DOUBLE) END AS south FROM faces),
lean AS (SELECT *, degrees(atan(sqrt(east * east + south * south))) AS slope,
  CASE WHEN sqrt(east * east + south * south) >= 1e-8 THEN fmod(degrees(atan2(-east, south)) + 360, 360) END AS aspect FROM plane),
slopes AS (SELECT *, CAST(floor(fmod(aspect + 22.5, 360) / 45) AS INTEGER) AS aspect_class FROM lean)"""

#: Sides of faces with sorted end points as text, and one row per edge.
EDGES = FACES + """,
kk AS (SELECT *, list_sort([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)]) AS ck FROM faces),
dk AS (SELECT ck, count(*) AS dup FROM kk GROUP BY ck),
sides AS (
  SELECT face, 0 AS slot, (x0, z0, h0) AS p, (x1, z1, h1) AS q, region, ck FROM kk UNION ALL SELECT face, 1, (x1, z1, h1), (x2, z2, h2), region, ck FROM kk UNION ALL SELECT face, 2, (x2, z2, h2), (x0, z0, h0), region, ck FROM kk),
occ AS (SELECT s.face, s.slot, least(p, q) AS a, greatest(p, q) AS b, region, dup > 1 AS dup FROM sides s JOIN dk USING (ck)),
rep AS (SELECT a, b, max(n) > 1 AS repeated FROM (SELECT a, b, face, count(*) AS n FROM occ GROUP BY a, b, face) GROUP BY a, b),
e0 AS (SELECT a, b, count(*) AS incidence, count(DISTINCT face) AS faces, bool_or(dup) AS dup, min(face) AS face, max(face) AS other, arg_min(region, face) AS region, arg_max(region, face) AS other_region FROM occ GROUP BY a, b),
e1 AS (SELECT e0.*, repeated, a = b OR incidence > 2 OR dup OR repeated AS amb, CASE WHEN a[1] = b[1] AND a[1] = 0 THEN 'west' WHEN a[1] = b[1] AND a[1] = 5000 THEN 'east' END AS side,
  least((a[2], a[3]), (b[2], b[3])) AS lo, greatest((a[2], a[3]), (b[2], b[3])) AS hi FROM e0 JOIN rep USING (a, b)),
e2 AS (SELECT x.*, y.face AS partner, CASE WHEN x.side IS NULL THEN 'none' WHEN y.side IS NULL THEN 'unmatched' WHEN x.incidence = 1 AND y.incidence = 1 AND NOT x.amb AND NOT y.amb AND x.face <> y.face THEN 'paired' ELSE 'ambiguous' END AS seam
  FROM e1 x LEFT JOIN e1 y ON x.lo = y.lo AND x.hi = y.hi AND x.side IS NOT NULL AND y.side IS NOT NULL AND x.side <> y.side),
edges AS (SELECT *, CAST((CASE WHEN incidence = 1 THEN 1 ELSE 0 END) + (CASE WHEN incidence > 2 THEN 2 ELSE 0 END) + (CASE WHEN a = b THEN 4 ELSE 0 END) + (CASE WHEN dup THEN 8 ELSE 0 END) + (CASE WHEN side IS NOT NULL THEN 16 ELSE 0 END)
  + (CASE WHEN amb OR (side IS NOT NULL AND seam <> 'paired') THEN 32 ELSE 0 END) + (CASE WHEN repeated THEN 64 ELSE 0 END) AS INTEGER) AS flags FROM e2),
bad AS (SELECT face, (z1 - z0) * (h2 - h0) = (h1 - h0) * (z2 - z0) AND (h1 - h0) * (x2 - x0) = (x1 - x0) * (h2 - h0) AND det = 0 AS degenerate FROM faces)"""

_BIN = "CASE WHEN slope < 5 THEN 0 WHEN slope < 15 THEN 1 WHEN slope < 30 THEN 2 WHEN slope < 45 THEN 3 WHEN slope < 60 THEN 4 WHEN slope < 75 THEN 5 WHEN slope IS NOT NULL THEN 6 END"


@query(SLOPES + f""",
k AS (SELECT list_sort([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)]) AS ck, count(*) AS dup FROM faces GROUP BY ck),
m AS (SELECT s.*, abs(det) AS area2, dup, {_BIN} AS bin FROM slopes s JOIN k ON ck = list_sort([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)]))
SELECT coalesce(region, -1) AS region, coalesce(terrain, -1) AS terrain, count(*) AS faces, CAST(sum(area2) AS BIGINT) AS area2, count(*) FILTER (det = 0) AS zero_xz, count(*) FILTER (dup > 1) AS duplicate_members, min(least(h0, h1, h2)) AS y_min, max(greatest(h0, h1, h2)) AS y_max,
  count(slope) AS slope_faces, CAST(coalesce(sum(area2) FILTER (slope IS NOT NULL), 0) AS BIGINT) AS slope_area2, round(sum(area2 * slope) / sum(area2) FILTER (slope IS NOT NULL), 6) AS slope_mean, count(*) FILTER (slope IS NOT NULL AND aspect IS NULL) AS flat_faces,
  {", ".join(f"CAST(coalesce(sum(area2) FILTER (bin = {b}), 0) AS BIGINT) AS slope_bin{b}" for b in range(7))}, {", ".join(f"CAST(coalesce(sum(area2) FILTER (aspect_class = {b}), 0) AS BIGINT) AS aspect{b}" for b in range(8))}
FROM m GROUP BY GROUPING SETS ((region, terrain), (region), (terrain), ())""")
def a2_region_terrain(spark, d):
    """Region by terrain with both margins and the total, -1 for all."""
    return tin.cross_tab(faces(spark, d)).fillna(-1, ["region", "terrain"])


@query(FACES + """, m AS (SELECT region, terrain, count(*) AS n, sum(abs(det)) AS s FROM faces GROUP BY ALL), w AS (SELECT region, sum(n) AS wn, sum(s) AS ws FROM m GROUP BY region)
SELECT region, terrain, n AS faces, round(100.0 * n / wn, 6) AS count_percent, round(CASE WHEN ws <> 0 THEN 100.0 * s / ws END, 6) AS area_percent FROM m JOIN w USING (region)""")
def a3_shares(spark, d):
    return tin.shares(faces(spark, d))


@query(FACES + """ SELECT region, arg_max(face, (abs(det), -face)) AS face, max(abs(det)) AS area2 FROM faces GROUP BY region""")
def a16_representative(spark, d):
    return tin.representative(faces(spark, d))


@query(FACES + """ SELECT face, det, abs(det) AS area2, det = 0 AS zero_xz, (z1 - z0) * (h2 - h0) = (h1 - h0) * (z2 - z0) AND (h1 - h0) * (x2 - x0) = (x1 - x0) * (h2 - h0) AND det = 0 AS degenerate_3d,
  least(x0, x1, x2) AS minx, greatest(x0, x1, x2) AS maxx, least(z0, z1, z2) AS minz, greatest(z0, z1, z2) AS maxz, round((x0 + x1 + x2) / 3, 6) AS cx, round((z0 + z1 + z2) / 3, 6) AS cz FROM faces""")
def f10_triangle_metrics(spark, d):
    """Determinant, area, degeneracy, bounds and centroid."""
    third = lambda a: F.round((F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3, 6)
    return tin.metrics(faces(spark, d)).select("face", "det", "area2", "zero_xz", "degenerate_3d", "minx", "maxx", "minz", "maxz", third("x").alias("cx"), third("z").alias("cz"))


@query(SLOPES + " SELECT face, round(slope, 6) AS slope, round(aspect, 6) AS aspect, coalesce(aspect_class, -1) AS aspect_class FROM slopes")
def f12_slope_aspect(spark, d):
    """Slope, aspect and the eight classes of aspect."""
    return tin.slope_aspect(faces(spark, d)).select("face", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"), F.coalesce("aspect_class", F.lit(-1)).alias("aspect_class"))


@query(FACES + """ SELECT region, terrain, script, chocobo, count(*) AS faces, CAST(sum(abs(det)) AS BIGINT) AS area2, CAST(min(least(x0, x1, x2)) AS BIGINT) AS minx, CAST(max(greatest(x0, x1, x2)) AS BIGINT) AS maxx, round(CASE WHEN sum(abs(det)) > 0 THEN sum(abs(det) * (z0 + z1 + z2)) / (3.0 * sum(abs(det))) END, 6) AS cz,
  round(CASE WHEN sum(abs(det)) > 0 AND sqrt(power(sum(abs(det) * sin(2 * pi() * (x0 + x1 + x2) / 15000.0)), 2) + power(sum(abs(det) * cos(2 * pi() * (x0 + x1 + x2) / 15000.0)), 2)) / sum(abs(det)) >= 1e-12 THEN sqrt(power(sum(abs(det) * sin(2 * pi() * (x0 + x1 + x2) / 15000.0)), 2) + power(sum(abs(det) * cos(2 * pi() * (x0 + x1 + x2) / 15000.0)), 2)) / sum(abs(det)) END, 6) AS resultant
  FROM faces GROUP BY region, terrain, script, chocobo""")
def a1_category_stats(spark, d):
    """Count, area, bounds, linear and circular centre by category (also A4)."""
    angle = 2 * F.pi() * (F.col("x0") + F.col("x1") + F.col("x2")) / 15000.0
    area = F.sum("area2")
    r = F.sqrt(F.sum(F.col("area2") * F.sin(angle)) ** 2 + F.sum(F.col("area2") * F.cos(angle)) ** 2) / F.nullif(area, F.lit(0))
    rows = tin.metrics(faces(spark, d)).groupBy("region", "terrain", "script", "chocobo")
    return rows.agg(F.count("*").alias("faces"), area.alias("area2"), F.min("minx").alias("minx"), F.max("maxx").alias("maxx"), F.round(F.sum(F.col("area2") * (F.col("z0") + F.col("z1") + F.col("z2"))) / F.nullif(3.0 * area, F.lit(0.0)), 6).alias("cz"), F.round(F.when(r >= 1e-12, r), 6).alias("resultant"))


@query(FACES + """ SELECT min(face) AS leader, count(*) AS members, count(*) - 1 AS excess FROM faces GROUP BY list_sort([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)]) HAVING count(*) > 1""")
def t1_duplicate_faces(spark, d):
    return tin.duplicates(faces(spark, d))


@query(EDGES + """ SELECT a[1] AS ax, a[2] AS az, a[3] AS ah, b[1] AS bx, b[2] AS bz, b[3] AS bh, incidence, flags, seam FROM edges""")
def t2_edge_index(spark, d):
    """Every edge with incidence, flags and seam status (also T4)."""
    return topology.edges(faces(spark, d), WIDTH).select("a.x", "a.z", "a.h", "b.x", "b.z", "b.h", "incidence", "flags", "seam").toDF("ax", "az", "ah", "bx", "bz", "bh", "incidence", "flags", "seam")


@query(EDGES + " SELECT incidence, count(*) AS edges FROM edges GROUP BY incidence")
def a11_incidence_histogram(spark, d):
    return topology.edges(faces(spark, d), WIDTH).groupBy("incidence").agg(F.count("*").alias("edges"))


@query(EDGES + """, f AS (SELECT o.face, bit_or(e.flags & 119) | (CASE WHEN bool_or(o.dup) THEN 8 ELSE 0 END) AS flags FROM occ o JOIN edges e USING (a, b) GROUP BY o.face) SELECT face, CAST(flags AS INTEGER) AS flags FROM f""")
def p6_face_flags(spark, d):
    """Flags of every face, for the filters boundary, nonmanifold, collapsed, duplicate, periodic, ambiguous."""
    return topology.face_flags(faces(spark, d), WIDTH)


_KIND = "CASE WHEN flags & 32 <> 0 THEN 'ambiguous' WHEN seam = 'paired' THEN 'periodic' WHEN incidence = 1 THEN 'open' WHEN region <> other_region THEN 'confirmed' ELSE 'internal' END"


@query(EDGES + f" SELECT {_KIND} AS kind, count(*) AS edges FROM edges GROUP BY 1")
def t6_boundary_kinds(spark, d):
    return topology.edges(faces(spark, d), WIDTH).groupBy(F.expr(_KIND).alias("kind")).agg(F.count("*").alias("edges"))


@query(EDGES + """, j AS (
  SELECT least(region, other_region) AS region_a, greatest(region, other_region) AS region_b, sqrt(power(a[1] - b[1], 2) + power(a[2] - b[2], 2)) AS len, 0 AS seam FROM edges e JOIN bad x ON x.face = e.face JOIN bad y ON y.face = e.other
  WHERE incidence = 2 AND faces = 2 AND NOT amb AND region <> other_region AND NOT x.degenerate AND NOT y.degenerate
  UNION ALL SELECT least(e.region, f.region), greatest(e.region, f.region), 0, 1 FROM edges e JOIN faces f ON f.face = e.partner WHERE side = 'west' AND seam = 'paired' AND e.region <> f.region)
SELECT region_a, region_b, count(*) FILTER (seam = 0) AS edges, round(sum(len), 6) AS length, CAST(sum(seam) AS BIGINT) AS seam_pairs FROM j GROUP BY ALL""")
def a20_region_adjacency(spark, d):
    return topology.adjacency(faces(spark, d), WIDTH)


@query(EDGES + " SELECT least(o.face, p.face) AS face_a, greatest(o.face, p.face) AS face_b, count(*) AS shared FROM occ o JOIN occ p ON o.a = p.a AND o.b = p.b AND o.face < p.face GROUP BY ALL")
def j10_edge_neighbours(spark, d):
    """Faces that share an exact edge."""
    return topology.neighbours(faces(spark, d))


_PARTS = """, pairs AS (
  SELECT e.face AS s, e.other AS t FROM edges e JOIN bad x ON x.face = e.face JOIN bad y ON y.face = e.other WHERE incidence = 2 AND faces = 2 AND NOT amb AND region = other_region AND NOT x.degenerate AND NOT y.degenerate{seam}),
sym AS (SELECT s, t FROM pairs UNION SELECT t, s FROM pairs), r AS (SELECT face AS v, face AS w FROM faces UNION SELECT r.v, sym.t FROM r JOIN sym ON r.w = sym.s),
part_of AS (SELECT v AS face, min(w) AS label FROM r GROUP BY v)"""
_SEAM = """ UNION SELECT e.face, e.partner FROM edges e JOIN faces f ON f.face = e.partner JOIN bad x ON x.face = e.face JOIN bad y ON y.face = e.partner WHERE side = 'west' AND seam = 'paired' AND NOT amb AND e.region = f.region AND NOT x.degenerate AND NOT y.degenerate"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH cell AS", "WITH RECURSIVE cell AS", 1)


def _parts(spark, d, seams):
    f = faces(spark, d)
    return f, graph.components(f.select(F.col("face").alias("node")), topology.links(f, WIDTH, seams))


@query(_recursive(EDGES) + _PARTS.format(seam="") + " SELECT face, label FROM part_of")
def t5_region_components(spark, d):
    """Strict components of each region, named by their smallest face."""
    return _parts(spark, d, False)[1].select(F.col("node").alias("face"), "label")


@query(_recursive(EDGES) + _PARTS.format(seam=_SEAM) + """, c AS (SELECT label, any_value(region) AS region, count(*) AS n, sum(abs(det)) AS area2 FROM part_of JOIN faces USING (face) GROUP BY label)
SELECT region, count(*) AS components, CAST(sum(n) AS BIGINT) AS faces, CAST(sum(area2) AS BIGINT) AS area2, arg_max(label, (n, -label)) AS largest, count(*) FILTER (n = 1) AS singletons FROM c GROUP BY region""")
def a19_component_stats(spark, d):
    """Components joined over the seam, rolled up by region (strategy B of T5; also O11)."""
    f, label = _parts(spark, d, True)
    c = tin.metrics(f).join(label.withColumnRenamed("node", "face"), "face").groupBy("label").agg(F.first("region").alias("region"), F.count("*").alias("n"), F.sum("area2").alias("area2"))
    return c.groupBy("region").agg(F.count("*").alias("components"), F.sum("n").alias("faces"), F.sum("area2").alias("area2"), F.max_by("label", F.struct("n", -F.col("label"))).alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))


_ARCS = """, ends AS (SELECT face AS s, other AS t FROM edges WHERE incidence = 2 AND faces = 2 AND NOT dup), arcs AS (SELECT s, t, 1 + (31 * s + 17 * t) % 9 AS w FROM ends UNION ALL SELECT t, s, 1 + (31 * s + 17 * t) % 9 FROM ends)"""


def _arcs(spark, d):
    e = topology.edges(faces(spark, d), WIDTH).where(F.expr(f"incidence = 2 AND faces = 2 AND flags & {topology.DUPLICATE} = 0"))
    one = e.select(F.col("face").alias("src"), F.col("other").alias("dst"), (1 + (31 * F.col("face") + 17 * F.col("other")) % 9).alias("weight"))
    return graph.both_ways(one)


@query(EDGES + _ARCS + " SELECT s AS src, t AS dst, w AS weight FROM arcs")
def g0_routing_arcs(spark, d):
    """Arcs between faces that share an edge of incidence two."""
    return _arcs(spark, d)


@query(_recursive(EDGES) + _ARCS + """, walk(node, dist, origin) AS (SELECT x, 0, x FROM (VALUES (20), (301)) v(x) UNION SELECT t, dist + w, origin FROM walk JOIN arcs ON node = s WHERE dist + w <= 20)
SELECT node, CAST(min(dist) AS BIGINT) AS distance, CAST(arg_min(origin, (dist, origin)) AS BIGINT) AS origin FROM walk GROUP BY node""")
def g3_service_area(spark, d):
    """What two stations reach within a distance of 20, and from which."""
    starts = spark.createDataFrame([(20,), (301,)], "node long")
    return graph.distances(_arcs(spark, d), starts, 20)


@query(EDGES + _ARCS + """, n AS (SELECT s AS node, count(*) AS degree FROM arcs GROUP BY s) SELECT node, degree, CAST(sum(degree) OVER (ORDER BY node) - degree AS BIGINT) AS "offset" FROM n""")
def w8_csr_offsets(spark, d):
    """Offsets of the arcs' compressed rows."""
    return ordered.offsets(_arcs(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "node", "degree")


#: Points with thirds, and every face under or over each with the exact heights there.
SURFACES = FACES + """, q AS (SELECT l_orderkey * 10 + l_linenumber AS qid, (l_partkey * 37 + l_suppkey * 11) % 15000 AS px, (l_partkey * 53 + l_linenumber * 7) % 12000 AS pz, 3 AS q FROM lineitem),
c AS (SELECT qid, px, pz, q, px // 300 AS cx, pz // 300 AS cz FROM q),
fb AS (SELECT *, least(x0, x1, x2) AS lx, greatest(x0, x1, x2) AS hx, least(z0, z1, z2) AS lz, greatest(z0, z1, z2) AS hz FROM faces),
fx AS (SELECT *, unnest(range(lx // 100, hx // 100 + 1)) AS cx FROM fb), fz AS (SELECT *, unnest(range(lz // 100, hz // 100 + 1)) AS cz FROM fx),
m AS (SELECT c.qid, c.px, c.pz, c.q, fz.* EXCLUDE (cx, cz), CASE WHEN det < 0 THEN -1 ELSE 1 END AS sg FROM c JOIN fz ON c.cx = fz.cx AND c.cz = fz.cz WHERE px BETWEEN lx * q AND hx * q AND pz BETWEEN lz * q AND hz * q),
w AS (SELECT *, CAST(sg * ((x2 - x1) * (pz - z1 * q) - (z2 - z1) * (px - x1 * q)) AS BIGINT) AS w0, CAST(sg * ((x0 - x2) * (pz - z2 * q) - (z0 - z2) * (px - x2 * q)) AS BIGINT) AS w1, CAST(sg * ((x1 - x0) * (pz - z0 * q) - (z1 - z0) * (px - x0 * q)) AS BIGINT) AS w2 FROM m),
h AS (SELECT qid, face, CASE WHEN least(w0, w1, w2) = 0 THEN 'boundary' ELSE 'inside' END AS kind, w0 * h0 + w1 * h1 + w2 * h2 AS lo, w0 * h0 + w1 * h1 + w2 * h2 AS hi, abs(det) * q AS d FROM w WHERE det <> 0 AND w0 >= 0 AND w1 >= 0 AND w2 >= 0),
wall AS (SELECT *, CASE WHEN x0 = x1 AND x1 = x2 THEN [z0, z1, z2] ELSE [x0, x1, x2] END AS u, CASE WHEN x0 = x1 AND x1 = x2 THEN pz ELSE px END AS p, [h0, h1, h2] AS hs FROM w WHERE det = 0 AND w0 = 0 AND w1 = 0 AND w2 = 0),
side AS (SELECT *, unnest([1, 2, 3]) AS i FROM wall), side2 AS (SELECT *, i % 3 + 1 AS j FROM side),
met AS (SELECT qid, face, hs[i] AS n, 1 AS d FROM side2 WHERE u[i] * q = p
  UNION ALL SELECT qid, face, sign(u[j] - u[i]) * (hs[i] * q * (u[j] - u[i]) + (hs[j] - hs[i]) * (p - u[i] * q)), abs(u[j] - u[i]) * q FROM side2 WHERE least(u[i], u[j]) * q < p AND p < greatest(u[i], u[j]) * q),
hv AS (SELECT wall.qid, wall.face, CASE WHEN (z1 - z0) * (h2 - h0) = (h1 - h0) * (z2 - z0) AND (h1 - h0) * (x2 - x0) = (x1 - x0) * (h2 - h0) THEN 'degenerate' ELSE 'vertical' END AS kind,
  CAST(min(n * 30000 / d) AS BIGINT) AS lo, CAST(max(n * 30000 / d) AS BIGINT) AS hi, 30000 AS d FROM wall JOIN met USING (qid, face) GROUP BY ALL),
every AS (SELECT * FROM h UNION ALL SELECT * FROM hv),
surfaces AS (SELECT qid, face, kind, CAST(lo // gcd(lo, d) AS BIGINT) AS low_n, CAST(d // gcd(lo, d) AS BIGINT) AS low_d, CAST(hi // gcd(hi, d) AS BIGINT) AS high_n, CAST(d // gcd(hi, d) AS BIGINT) AS high_d FROM every)"""


def _surface_points(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qid"), ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 15000).alias("px"), ((F.col("l_partkey") * 53 + F.col("l_linenumber") * 7) % 12000).alias("pz"), F.lit(3).cast("long").alias("q"))


@query(SURFACES + " SELECT * FROM surfaces")
def j7_surfaces_at_points(spark, d):
    """Exact rational heights of all surfaces over points with thirds, walls and degenerate faces with their interval."""
    return tin.surfaces_at(faces(spark, d), _surface_points(spark, d))


@query(SURFACES + """, n AS (SELECT qid, count(*) AS hits, count(DISTINCT (low_n, low_d)) FILTER (kind IN ('inside', 'boundary')) AS heights, count(*) FILTER (kind NOT IN ('inside', 'boundary')) AS odd FROM surfaces GROUP BY qid)
SELECT coalesce(CASE WHEN hits = odd THEN 'diagnostics' WHEN heights = 1 AND odd = 0 THEN 'single' WHEN heights = 1 THEN 'single_with_diagnostics' WHEN hits > 0 THEN 'multiple' END, 'empty') AS status, count(*) AS points FROM q LEFT JOIN n USING (qid) GROUP BY 1""")
def a27_height_counts(spark, d):
    """Points by the number of different exact heights over them."""
    points = _surface_points(spark, d)
    plain = F.col("kind").isin("inside", "boundary")
    n = tin.surfaces_at(faces(spark, d), points).groupBy("qid").agg(F.count("*").alias("hits"), F.count_distinct(F.when(plain, F.struct("low_n", "low_d"))).alias("heights"), F.count_if(~plain).alias("odd"))
    status = F.when(F.col("hits") == F.col("odd"), "diagnostics").when((F.col("heights") == 1) & (F.col("odd") == 0), "single").when(F.col("heights") == 1, "single_with_diagnostics").when(F.col("hits") > 0, "multiple").otherwise("empty")
    return points.join(n, "qid", "left").groupBy(status.alias("status")).agg(F.count("*").alias("points"))


@query(SURFACES + """, one AS (SELECT qid, any_value(low_n) AS n, any_value(low_d) AS d FROM surfaces GROUP BY qid HAVING count(*) = 1 AND any_value(kind) IN ('inside', 'boundary'))
SELECT a.qid, CAST(b.n * a.d - a.n * b.d AS BIGINT) AS delta_n, CAST(a.d * b.d AS BIGINT) AS delta_d, abs(CAST(b.n AS DOUBLE) / b.d - CAST(a.n AS DOUBLE) / a.d) < 200 AS passable FROM one a JOIN one b ON b.qid = a.qid + 1""")
def f24_height_delta(spark, d):
    """Exact difference of heights from a point to the next, where each has one ordinary surface (also P17: less than 200)."""
    plain = F.col("kind").isin("inside", "boundary")
    one = tin.surfaces_at(faces(spark, d), _surface_points(spark, d)).groupBy("qid").agg(F.count("*").alias("hits"), *[F.max(F.when(plain, F.col(f"low_{x}"))).alias(x) for x in "nd"]).where("hits = 1 AND n IS NOT NULL")
    # a point's height goes to its own row and to that of the point before: nothing is joined, so no surface is looked up twice
    both = one.selectExpr("explode(array(struct(qid, n, d, NULL AS n2, NULL AS d2), struct(qid - 1 AS qid, NULL AS n, NULL AS d, n AS n2, d AS d2))) AS x").select("x.*")
    met = both.groupBy("qid").agg(*[F.max(x).alias(x) for x in ("n", "d", "n2", "d2")]).where("n IS NOT NULL AND n2 IS NOT NULL")
    return met.select("qid", F.expr("n2 * d - n * d2").alias("delta_n"), F.expr("d * d2").alias("delta_d"), F.expr("abs(double(n2) / d2 - double(n) / d) < 200").alias("passable"))


@query(FACES + """, rule AS (SELECT face, region, terrain, CASE terrain WHEN 16 THEN 0 WHEN 24 THEN 8 ELSE terrain END AS t, least(region, 15) AS r FROM faces),
slots AS (SELECT r, s, (r * 5 + s * 7) % 32 AS st FROM range(16) a(r), range(4) b(s))
SELECT face, r || ':' || coalesce(min(s) FILTER (st = t), 0) AS set_id, count(*) FILTER (st = t) = 0 AS fallback FROM rule JOIN slots USING (r) GROUP BY face, r""")
def j3_encounter_set(spark, d):
    """Face to encounter set: clamped region, terrain aliases, first matching slot, else slot 0 with fallback."""
    r, t = F.least("region", F.lit(15)), F.when(F.col("terrain") == 16, 0).when(F.col("terrain") == 24, 8).otherwise(F.col("terrain"))
    slots = F.array(*[(F.col("r") * 5 + s * 7) % 32 for s in range(4)])
    at = F.array_position(slots, F.col("t"))
    return faces(spark, d).select("face", r.alias("r"), t.alias("t")).select("face", F.concat_ws(":", "r", F.greatest(at - 1, F.lit(0)).cast("string")).alias("set_id"), (at == 0).alias("fallback"))


@query("""WITH s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') SELECT e.event_id, coalesce((SELECT arg_max(s.event_id, (s.ts, s.event_id)) FROM s WHERE s.user_id = e.user_id AND s.ts <= e.ts), -1) AS state FROM events e""")
def j4_as_of(spark, d):
    """Each event with its user's last signup at or before it (-1: none)."""
    events = table(spark, d, "events")
    signups = events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return ordered.as_of(events.select("user_id", "ts", F.col("event_id").alias("id")), signups, "user_id", "ts", "event_id").select(F.col("id").alias("event_id"), F.coalesce("state", F.lit(-1)).alias("state"))


@query("""WITH l AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, min(value) AS low, max(value) AS high, round(sum(greatest(coalesce(d, 0), 0)), 6) AS ascent, round(sum(greatest(-coalesce(d, 0), 0)), 6) AS descent FROM l GROUP BY user_id""")
def w2_ascent(spark, d):
    """Ascent and descent of each user's values in order."""
    return ordered.profile(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


_IV = "iv AS (SELECT l_suppkey AS key, (l_orderkey * 13) % 100000 AS lo, (l_orderkey * 13) % 100000 + CAST(l_quantity AS BIGINT) AS hi FROM lineitem)"
_MERGED = _IV + """, m0 AS (SELECT *, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
m1 AS (SELECT *, sum(CASE WHEN reach >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m0), merged AS (SELECT key, min(lo) AS lo, max(hi) AS hi FROM m1 GROUP BY key, run)"""


def _intervals(spark, d):
    lo = (F.col("l_orderkey") * 13) % 100000
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi"))


@query(f"WITH {_MERGED} SELECT key, lo, hi FROM merged")
def w4_merged_intervals(spark, d):
    return ordered.merged(_intervals(spark, d), "key")


@query(f"""WITH {_MERGED} SELECT key, coalesce(lag(hi) OVER (PARTITION BY key ORDER BY lo), 0) AS lo, lo AS hi FROM merged QUALIFY coalesce(lag(hi) OVER (PARTITION BY key ORDER BY lo), 0) < lo
UNION ALL SELECT key, max(hi), 100100 FROM merged GROUP BY key HAVING max(hi) < 100100""")
def w5_uncovered(spark, d):
    """What the intervals leave uncovered of [0, 100100]."""
    return ordered.gaps(_intervals(spark, d), "key", F.lit(0).cast("long"), F.lit(100100).cast("long"))


@query("""WITH v AS (SELECT user_id, event_type, max((ts, event_id)) AS seen FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, event_type) AS INTEGER) AS place FROM v QUALIFY place <= 3""")
def w12_recent(spark, d):
    """Move-to-front lists of three."""
    return ordered.recent(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], 3)


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY k), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY k)
SELECT coalesce(a.k, b.k) AS k, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS common, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS only_a, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS only_b FROM a FULL JOIN b ON a.k = b.k""")
def u1_multiset(spark, d):
    """Common and left-over occurrences of two multisets."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return multiset.compared(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), ["k"])


def _changed(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c, c.where(k % 7 != 0).withColumns({"c_acctbal": F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(k % 3 == 0, "NEW").otherwise(F.col("c_mktsegment"))}).withColumn("c_custkey", F.when(k % 11 == 0, k + 10_000_000).otherwise(k))


_NEW = """WITH n AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)"""


@query(_NEW + """, m AS (SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, c.c_custkey IS NULL AS added, n.c_custkey IS NULL AS missing, concat_ws(',', CASE WHEN c.c_name IS DISTINCT FROM n.c_name THEN 'c_name' END, CASE WHEN c.c_acctbal IS DISTINCT FROM n.c_acctbal THEN 'c_acctbal' END, CASE WHEN c.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'c_mktsegment' END) AS f FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey)
SELECT c_custkey, CASE WHEN added THEN 'added' WHEN missing THEN 'missing' WHEN f = '' THEN 'unchanged' ELSE 'conflict' END AS status, CASE WHEN added OR missing THEN '' ELSE f END AS fields FROM m""")
def j36_version_diff(spark, d):
    """Incoming rows against local ones."""
    return multiset.versions(*_changed(spark, d), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query(_NEW + " SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM n UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def j37_upsert(spark, d):
    return multiset.upserted(*_changed(spark, d), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query("SELECT 'orders.customer' AS check_name, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'nation.region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)")
def j34_references(spark, d):
    """Rows whose reference is missing."""
    out = None
    for name, child, fk, parent, pk in (("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("lineitem.orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("nation.region", "nation", "n_regionkey", "region", "r_regionkey")):
        lost = table(spark, d, child).join(table(spark, d, parent), F.col(fk) == F.col(pk), "left_anti").agg(F.count("*").alias("violations"))
        lost = lost.select(F.lit(name).alias("check_name"), "violations")
        out = lost if out is None else out.union(lost)
    return out


@query("SELECT CAST(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END + CASE WHEN l_tax > 0.04 THEN 2 ELSE 0 END AS INTEGER) AS class, count(*) AS n FROM lineitem GROUP BY 1")
def a21_confusion(spark, d):
    """Counts of two conditions' four classes."""
    one = (F.col("l_discount") > 0.05).cast("int") + 2 * (F.col("l_tax") > 0.04).cast("int")
    return table(spark, d, "lineitem").groupBy(one.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(*) AS valid, round(sqrt(avg(power(l_extendedprice - l_quantity * 1000, 2))), 4) AS rms, round(quantile_cont(abs(l_extendedprice - l_quantity * 1000), 0.5), 6) AS median, round(max(abs(l_extendedprice - l_quantity * 1000)), 6) AS worst FROM lineitem GROUP BY l_suppkey")
def a22_residuals(spark, d):
    """RMS, exact median and largest residual."""
    off = F.col("l_extendedprice") - F.col("l_quantity") * 1000
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("valid"), F.round(F.sqrt(F.avg(off**2)), 4).alias("rms"), F.round(F.percentile(F.abs(off), 0.5), 6).alias("median"), F.round(F.max(F.abs(off)), 6).alias("worst"))


def _places(spark, d):
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", ((s * 137) % 360 - 180).cast("double").alias("lon"), ((s * 71) % 160 - 80).cast("double").alias("lat"))


_PLACES = "WITH p AS (SELECT s_suppkey, s_nationkey, CAST((s_suppkey * 137) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey * 71) % 160 - 80 AS DOUBLE) AS lat FROM supplier), v AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM p)"


@query(_PLACES + """, n AS (SELECT n_nationkey, CAST((n_nationkey * 61) % 360 - 180 AS DOUBLE) AS qlon, CAST((n_nationkey * 29) % 160 - 80 AS DOUBLE) AS qlat FROM nation), q AS (SELECT *, cos(radians(qlat)) * cos(radians(qlon)) AS a, cos(radians(qlat)) * sin(radians(qlon)) AS b, sin(radians(qlat)) AS c FROM n),
d AS (SELECT n_nationkey, s_suppkey, 6371008.8 * atan2(sqrt(power(b * z - c * y, 2) + power(c * x - a * z, 2) + power(a * y - b * x, 2)), greatest(-1, least(1, a * x + b * y + c * z))) AS dist FROM q, v)
SELECT n_nationkey, s_suppkey, round(dist, 3) AS distance, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY round(dist, 3), s_suppkey) AS INTEGER) AS rank FROM d WHERE dist <= 6000000 QUALIFY rank <= 5""")
def o1_nearest_places(spark, d):
    """The five nearest places to each nation's point within 6,000 km.

    The points are the stated queries (one per nation, broadcast only up to 10,000 of
    them); each task keeps its own five nearest before the rows are shuffled.
    """
    n = F.col("n_nationkey")
    q = table(spark, d, "nation").select("n_nationkey", ((n * 61) % 360 - 180).cast("double").alias("qlon"), ((n * 29) % 160 - 80).cast("double").alias("qlat"))
    points = [(r["n_nationkey"], r["qlon"], r["qlat"]) for r in q.limit(10_001).collect()]
    if len(points) > 10_000:
        raise ValueError("state at most 10,000 points")
    # every query within one latitude band of its radius: places are dealt to bands of 10 degrees
    reach = 6_000_000 / sphere.RADIUS * 180 / 3.141592653589793
    banded = spark.createDataFrame([(k, lon, lat, b) for k, lon, lat in points for b in range(int((max(-90, lat - reach) + 90) // 10), int((min(90, lat + reach) + 90) // 10) + 1)], "n_nationkey int, qlon double, qlat double, band int")
    near = _places(spark, d).withColumn("band", F.floor((F.col("lat") + 90) / 10).cast("int")).join(F.broadcast(banded), "band")
    near = near.withColumn("exact", sphere.RADIUS * sphere.central_angle(F.col("qlon"), F.col("qlat"), F.col("lon"), F.col("lat"))).where("exact <= 6000000").withColumn("distance", F.round("exact", 3))
    rank = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("distance", "s_suppkey"))
    return near.select("n_nationkey", "s_suppkey", "distance", rank.alias("rank")).where("rank <= 5")


@query(_PLACES + """, m AS (SELECT s_nationkey, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM v GROUP BY s_nationkey), r AS (SELECT *, sqrt(x * x + y * y + z * z) AS norm FROM m)
SELECT s_nationkey, round(norm, 6) AS concentration, round(CASE WHEN norm >= 1e-10 THEN z / norm END, 6) + 0.0 AS up, round(CASE WHEN norm >= 1e-10 THEN x / norm END, 6) + 0.0 AS front, round(CASE WHEN norm >= 1e-10 THEN y / norm END, 6) + 0.0 AS left_ FROM r""")
def a14_spherical_centre(spark, d):
    """Centre direction of the places of each nation (also A13); null where they cancel out."""
    x, y, z = sphere.vector(F.col("lon"), F.col("lat"))
    m = _places(spark, d).groupBy("s_nationkey").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z")).withColumn("norm", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    part = lambda c: F.round(F.when(F.col("norm") >= 1e-10, F.col(c) / F.col("norm")), 6) + 0.0
    return m.select("s_nationkey", F.round("norm", 6).alias("concentration"), part("z").alias("up"), part("x").alias("front"), part("y").alias("left_"))


@query("""WITH p AS (SELECT s_suppkey, radians(CAST((s_suppkey * 137) % 360 - 180 AS DOUBLE)) AS l, radians(CAST((s_suppkey * 71) % 160 - 80 AS DOUBLE)) AS p FROM supplier), e AS (SELECT *, asin(sqrt(3) / 2 * sin(p)) AS a, acos(greatest(-1, least(1, cos(p) * cos(l / 2)))) AS w, acos(greatest(-1, least(1, cos(p) * cos(l)))) AS c FROM p)
SELECT s_suppkey, projection, x + 0.0 AS x, y + 0.0 AS y FROM (SELECT s_suppkey, 'equirectangular' AS projection, round(l, 6) AS x, round(p, 6) AS y FROM e UNION ALL SELECT s_suppkey, 'mercator', round(l, 6), round(ln(tan(pi() / 4 + p / 2)), 6) FROM e
UNION ALL SELECT s_suppkey, 'sinusoidal', round(l * cos(p), 6), round(p, 6) FROM e UNION ALL SELECT s_suppkey, 'gall-peters', round(l / sqrt(2), 6), round(sqrt(2) * sin(p), 6) FROM e
UNION ALL SELECT s_suppkey, 'equal-earth', round(2 * l * cos(a) / (sqrt(3) * (1.340264 - 3 * 0.081106 * a ** 2 + 7 * 0.000893 * a ** 6 + 9 * 0.003796 * a ** 8)), 6), round(a * (1.340264 - 0.081106 * a ** 2 + 0.000893 * a ** 6 + 0.003796 * a ** 8), 6) FROM e
UNION ALL SELECT s_suppkey, 'natural-earth', round(l * (0.8707 - 0.131979 * p ** 2 - 0.013791 * p ** 4 + 0.003971 * p ** 10 - 0.001529 * p ** 12), 6), round(p * (1.007226 + 0.015085 * p ** 2 - 0.044475 * p ** 6 + 0.028874 * p ** 8 - 0.005916 * p ** 10), 6) FROM e
UNION ALL SELECT s_suppkey, 'winkel-tripel', round((2 * cos(p) * sin(l / 2) / (CASE WHEN w < 1e-12 THEN 1 ELSE sin(w) / w END) + l * 2 / pi()) / 2, 6), round((sin(p) / (CASE WHEN w < 1e-12 THEN 1 ELSE sin(w) / w END) + p) / 2, 6) FROM e
UNION ALL SELECT s_suppkey, 'orthographic', round(cos(p) * sin(l), 6), round(sin(p), 6) FROM e
UNION ALL SELECT s_suppkey, 'laea', round(CASE WHEN cos(p) * cos(l) < -1 + 1e-10 THEN 0 ELSE sqrt(2 / (1 + cos(p) * cos(l))) * cos(p) * sin(l) END, 6), round(CASE WHEN cos(p) * cos(l) < -1 + 1e-10 THEN 0 ELSE sqrt(2 / (1 + cos(p) * cos(l))) * sin(p) END, 6) FROM e
UNION ALL SELECT s_suppkey, 'aeqd', round(CASE WHEN cos(p) * cos(l) < -1 + 1e-10 THEN 0 WHEN c < 1e-10 THEN cos(p) * sin(l) ELSE c / sin(c) * cos(p) * sin(l) END, 6), round(CASE WHEN cos(p) * cos(l) < -1 + 1e-10 THEN 0 WHEN c < 1e-10 THEN sin(p) ELSE c / sin(c) * sin(p) END, 6) FROM e)""")
def f51_projections(spark, d):
    """Ten projections of all places."""
    return _projected(spark, d, [n for n in sphere.PROJECTIONS if n not in ("mollweide", "robinson", "globe")])


def _projected(spark, d, names):
    lon, lat = F.col("lon"), F.col("lat")
    each = F.array(*[F.struct(F.lit(n).alias("projection"), *[F.round(v, 6).alias(a) for a, v in zip("xy", sphere.project(n, lon, lat), strict=True)]) for n in names])
    # + 0.0 makes one zero of both signs
    return _places(spark, d).select("s_suppkey", F.explode(each).alias("e")).select("s_suppkey", "e.projection", (F.col("e.x") + 0.0).alias("x"), (F.col("e.y") + 0.0).alias("y"))


@query()
def f51_projections_solved(spark, d):
    """Mollweide (Newton steps) and Robinson (control table)."""
    return _projected(spark, d, ["mollweide", "robinson"])


@query("""WITH n AS (SELECT p_partkey, p_name, lower(trim(p_name)) AS n FROM part) SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, CASE WHEN n = 'small ring' THEN 0 WHEN starts_with(n, 'small ring') THEN 1 WHEN contains(n, 'small ring') THEN 2 WHEN levenshtein(n, 'small ring') <= 1 THEN 4 END AS rank FROM n) WHERE rank IS NOT NULL""")
def o2_ranked_search(spark, d):
    """Parts by name: equal, beginning, holding, one edit away."""
    return search.ranked(table(spark, d, "part"), "Small  ring", "p_name").select("p_partkey", "p_name", "rank")


@query("SELECT t AS terrain, p AS profile, CASE WHEN (m >> t) & 1 = 1 THEN CASE WHEN t IN (13, 14, 30) THEN 'conditional' ELSE 'allowed' END ELSE 'blocked' END AS state, count(*) AS faces FROM (SELECT p_size % 32 AS t FROM part) x, (VALUES ('walk', 16762879), ('ship', 4026531848)) y(p, m) GROUP BY ALL")
def p15_routing_state(spark, d):
    """Terrain masks of travel profiles: allowed, conditional, blocked."""
    terrain = table(spark, d, "part").groupBy((F.col("p_size") % 32).alias("terrain")).agg(F.count("*").alias("faces"))
    each = F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(m).cast("long").alias("mask")) for n, m in (("walk", 16762879), ("ship", 4026531848))])
    rows = terrain.select("terrain", "faces", F.explode(each).alias("p")).select("terrain", "faces", "p.*")
    state = F.when(F.expr("shiftright(mask, terrain) & 1 = 1"), F.when(F.col("terrain").isin(13, 14, 30), "conditional").otherwise("allowed")).otherwise("blocked")
    return rows.select("terrain", "profile", state.alias("state"), "faces")
