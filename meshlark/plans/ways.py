"""Queries over ways along a surface, evidence chains, polar caps and records of surfaces written as bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions import binary as b
from meshlark.functions import sphere
from meshlark.operators import corridor, graph, network, tin, topology
from meshlark.plans.catalog import FACES, SURFACES, _recursive, _surface_points, query
from meshlark.plans.travel import _CALLS, _SCENES, _access
from meshlark.sources.tables import WIDTH, faces, table

HEIGHT = 4000

_WELD = FACES + """, dk AS (SELECT list_sort([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)]) AS ck, count(*) AS dup FROM faces GROUP BY 1),
ff AS (SELECT f.*, dup FROM faces f JOIN dk ON ck = list_sort([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)])),
sd AS (SELECT face, dup, unnest([[(x0 % 5000, z0, h0), (x1 % 5000, z1, h1)], [(x1 % 5000, z1, h1), (x2 % 5000, z2, h2)], [(x2 % 5000, z2, h2), (x0 % 5000, z0, h0)]]) AS e FROM ff),
oc AS (SELECT face, dup, least(e[1], e[2]) AS a, greatest(e[1], e[2]) AS b FROM sd),
ed AS (SELECT min(face) AS f, max(face) AS g FROM oc GROUP BY a, b HAVING count(*) = 2 AND min(face) <> max(face) AND max(dup) = 1 AND a <> b),
arcs AS (SELECT f AS s, g AS t FROM ed UNION SELECT g, f FROM ed)"""

_GEO = "SELECT face, terrain, {x} / 5000.0 * 360 - 180 AS lon, degrees(atan((exp(pi() * (1 - 2 * {z} / 4000.0)) - exp(-pi() * (1 - 2 * {z} / 4000.0))) / 2)) AS lat"


@query(_WELD + ", pt AS (" + _GEO.format(x="((x0 + x1 + x2) / 3.0)", z="((z0 + z1 + z2) / 3.0)") + """ FROM faces)
SELECT s AS src, t AS dst, CAST(round(2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * power(sin(radians(q.lon - p.lon) / 2), 2)))) * 1000) AS BIGINT) AS weight FROM arcs JOIN pt p ON p.face = s JOIN pt q ON q.face = t""")
def g0_welded_graph(spark, d):
    """Arcs between neighbours over welded edges, weighted with the distance of their centres."""
    return corridor.weighted(faces(spark, d), WIDTH, HEIGHT)


@query(_recursive(_WELD) + """, ok AS (SELECT face, abs(det) AS area2 FROM faces WHERE terrain < 11), la AS (SELECT s, t FROM arcs JOIN ok x ON x.face = s JOIN ok y ON y.face = t), r AS (SELECT face AS v, face AS w FROM ok UNION SELECT r.v, la.t FROM r JOIN la ON r.w = la.s),
l AS (SELECT v AS face, min(w) AS label FROM r GROUP BY v), c AS (SELECT label, count(*) AS faces, CAST(sum(area2) AS BIGINT) AS area2, row_number() OVER (ORDER BY label) - 1 AS component FROM l JOIN ok USING (face) GROUP BY label)
SELECT l.face, component, faces, area2 FROM l JOIN c USING (label)""")
def g1_eligible_components(spark, d):
    """Components among the faces a profile may enter, numbered by their first face, with size and area."""
    return corridor.eligible_components(faces(spark, d), WIDTH, F.col("terrain") < 11)


_LEGS = FACES + """, st AS (SELECT l_orderkey AS trip, l_linenumber AS seq, 2 * l_partkey AS src, 2 * l_partkey + 1 + CASE WHEN l_linenumber = 5 THEN 2 ELSE 0 END AS dst FROM lineitem),
j AS (SELECT trip, seq, src, dst, [(a.x0, a.z0, a.h0), (a.x1, a.z1, a.h1), (a.x2, a.z2, a.h2)] AS own, [(b.x0 % 5000, b.z0, b.h0), (b.x1 % 5000, b.z1, b.h1), (b.x2 % 5000, b.z2, b.h2)] AS ring, (a.x0 + a.x1 + a.x2) / 3.0 AS ax, (a.z0 + a.z1 + a.z2) / 3.0 AS az, (a.h0 + a.h1 + a.h2) / 3.0 AS ah, (b.x0 + b.x1 + b.x2) / 3.0 AS bx, (b.z0 + b.z1 + b.z2) / 3.0 AS bz, (b.h0 + b.h1 + b.h2) / 3.0 AS bh, a.terrain AS ta, b.terrain AS tb FROM st JOIN faces a ON a.face = src JOIN faces b ON b.face = dst),
sh AS (SELECT *, list_filter(own, lambda p: list_contains(ring, (p[1] % 5000, p[2], p[3]))) AS sh FROM j),
mi AS (SELECT *, len(sh) = 2 AS good, list_sum(list_transform(sh, lambda p: p[1])) / 2.0 AS mx, list_sum(list_transform(sh, lambda p: p[2])) / 2.0 AS mz, list_sum(list_transform(sh, lambda p: p[3])) / 2.0 AS mh FROM sh),
lg AS (SELECT trip, seq, src, 0 AS part, src AS face, ta AS terrain, good, ax AS x1, az AS z1, mx AS x2, mz AS z2, ah AS h0, mh AS h1 FROM mi UNION ALL SELECT trip, seq, src, 1, dst, tb, good, mx + floor((bx - mx) / 5000 + 0.5) * 5000, mz, bx, bz, mh, bh FROM mi),
gl AS (SELECT *, radians(x1 / 5000.0 * 360 - 180) AS l1, radians(x2 / 5000.0 * 360 - 180) AS l2, atan((exp(pi() * (1 - 2 * z1 / 4000.0)) - exp(-pi() * (1 - 2 * z1 / 4000.0))) / 2) AS p1, atan((exp(pi() * (1 - 2 * z2 / 4000.0)) - exp(-pi() * (1 - 2 * z2 / 4000.0))) / 2) AS p2 FROM lg),
di AS (SELECT *, CASE WHEN good THEN 2 * 6371008.8 * asin(sqrt(least(1, power(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * power(sin((l2 - l1) / 2), 2)))) END AS distance FROM gl)"""


def _steps(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), n.alias("seq"), (2 * p).alias("src"), (2 * p + 1 + F.when(n == 5, 2).otherwise(0)).alias("dst"))


@query(_LEGS + """ SELECT trip, seq, part, face, CASE WHEN good THEN 'ok' ELSE 'error' END AS status, round(coalesce(distance, 0), 1) AS distance, round(sum(coalesce(distance, 0)) OVER (PARTITION BY trip ORDER BY seq, src, part ROWS UNBOUNDED PRECEDING), 1) AS running FROM di""")
def g4_corridor_legs(spark, d):
    """Legs over the middle of shared edges, with the distance so far on each trip."""
    rows = corridor.running(corridor.legs(_steps(spark, d), faces(spark, d), WIDTH, HEIGHT, "trip", heights=False))
    return rows.select("trip", "seq", "part", "face", "status", F.round(F.coalesce("distance", F.lit(0.0)), 1).alias("distance"), F.round("running", 1).alias("running"))


@query(_LEGS + """, t AS (SELECT terrain, count(*) AS legs, sum(distance) AS distance FROM di WHERE good GROUP BY terrain) SELECT terrain, legs, round(distance / 1000, 3) AS km, round(100 * distance / (SELECT sum(distance) FROM t), 6) AS percent FROM t""")
def a17_route_exposure(spark, d):
    """Distance and share of the ways by terrain."""
    f = faces(spark, d)
    return corridor.exposure(corridor.legs(_steps(spark, d), f, WIDTH, HEIGHT), f, "terrain").select("terrain", "legs", F.round(F.col("distance") / 1000, 3).alias("km"), F.round("percent", 6).alias("percent"))


@query(_LEGS + """ SELECT trip, round(min(least(h0, h1)), 6) AS low, round(max(greatest(h0, h1)), 6) AS high, round(sum(greatest(0, h1 - h0)), 6) AS ascent, round(sum(greatest(0, h0 - h1)), 6) AS descent, round(sum(distance), 1) AS length FROM di WHERE good GROUP BY trip""")
def g5_route_profiles(spark, d):
    """Length, heights, ascent and descent of each trip."""
    rows = corridor.legs(_steps(spark, d), faces(spark, d), WIDTH, HEIGHT, "trip").where("status = 'ok'")
    rise = F.col("to_h") - F.col("from_h")
    zero = F.lit(0.0)
    return rows.groupBy("trip").agg(F.round(F.min(F.least("from_h", "to_h")), 6).alias("low"), F.round(F.max(F.greatest("from_h", "to_h")), 6).alias("high"), F.round(F.sum(F.greatest(zero, rise)), 6).alias("ascent"), F.round(F.sum(F.greatest(zero, -rise)), 6).alias("descent"), F.round(F.sum("distance"), 1).alias("length"))


@query(_SCENES + """, s AS (SELECT x.field, x.a AS tri, min(x.b) AS strong FROM near x JOIN near y ON x.a = y.b AND x.b = y.a GROUP BY ALL), p AS (SELECT field, tri, strong, CASE WHEN tri % 10 = 3 THEN tri % 4 END AS place FROM s),
c AS (SELECT strong, count(DISTINCT place) AS n, min(place) AS place FROM p GROUP BY strong)
SELECT tri, CASE WHEN p.place IS NOT NULL THEN 'verified_direct' WHEN n = 1 THEN 'verified_parent' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CAST(coalesce(p.place, CASE WHEN n = 1 THEN c.place END, -1) AS BIGINT) AS place FROM p JOIN c USING (strong)""")
def g13_parent_places(spark, d):
    """Places of scenes: their own, or the only one of the scenes that lead to each other."""
    own = network.components(_access(spark, d)).select("tri", "strong", F.when(F.expr("tri % 10 = 3"), F.expr("tri % 4")).alias("place"))
    c = own.groupBy("strong").agg(F.count_distinct("place").alias("n"), F.min("place").alias("shared"))
    status = F.when(F.col("place").isNotNull(), "verified_direct").when(F.col("n") == 1, "verified_parent").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return own.join(c, "strong").select("tri", status.alias("status"), F.coalesce("place", F.when(F.col("n") == 1, F.col("shared")), F.lit(-1)).cast("long").alias("place"))


@query(_SCENES + """, back(tri, n) AS (SELECT tri, 0 FROM tris WHERE tri % 40 = 0 UNION SELECT s, n + 1 FROM back JOIN arcs ON t = back.tri WHERE n < 60), m AS (SELECT tri, min(n) AS n FROM back GROUP BY tri)
SELECT tri, CAST(coalesce(n, -1) AS BIGINT) AS steps, CASE WHEN n = 0 THEN 'native' WHEN n IS NULL THEN 'no_chain' ELSE 'chain' END AS evidence FROM tris LEFT JOIN m USING (tri)""")
def g15_evidence_chains(spark, d):
    """Fewest links from each scene to a native entry, found backwards from the entries."""
    access = _access(spark, d)
    own = access.select("tri").distinct()
    back = access.where("dst IS NOT NULL").join(own.select(F.col("tri").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("tri").alias("dst"), F.lit(1).cast("long").alias("weight")).distinct()
    n = graph.distances(back, own.where("tri % 40 = 0").select(F.col("tri").alias("node")))
    j = own.join(n, F.col("tri") == F.col("node"), "left")
    return j.select("tri", F.coalesce("distance", F.lit(-1)).alias("steps"), F.when(F.col("distance") == 0, "native").when(F.col("distance").isNull(), "no_chain").otherwise("chain").alias("evidence"))


@query(_SCENES + """, walk(field, tri, level) AS (SELECT field, min(tri), 0 FROM tris GROUP BY field UNION SELECT walk.field, t, level + 1 FROM walk JOIN arcs ON tri = s WHERE level < 40), l AS (SELECT field, tri, min(level) AS level FROM walk GROUP BY ALL),
k AS (SELECT field, min((level, tri)) AS x, count(*) AS n FROM l WHERE tri % 9 = 4 AND tri % 18 <> 4 GROUP BY field), f AS (SELECT DISTINCT field FROM tris)
SELECT f.field, CAST(coalesce(x[2], -1) AS BIGINT) AS contact, CAST(coalesce(x[1], -1) AS BIGINT) AS steps, coalesce(n, 0) AS reachable FROM f LEFT JOIN k USING (field)""")
def g18_nearest_contact(spark, d):
    """The nearest reachable contact without a mismatch in each scene, ties to the smaller."""
    access = _access(spark, d)
    starts = access.groupBy("field").agg(F.min("tri").alias("start"))
    found = network.reach(access, starts).select("tri", "level").where("level IS NOT NULL AND tri % 9 = 4 AND tri % 18 <> 4")
    k = found.join(access.select("field", "tri").distinct(), "tri").groupBy("field").agg(F.min(F.struct("level", "tri")).alias("x"), F.count("*").alias("n"))
    return starts.join(k, "field", "left").select("field", F.coalesce("x.tri", F.lit(-1)).alias("contact"), F.coalesce("x.level", F.lit(-1)).cast("long").alias("steps"), F.coalesce("n", F.lit(0)).alias("reachable"))


@query(_SCENES + """, g AS (SELECT p_partkey AS gate, p_partkey AS a, (p_partkey * 13 + 7) % 260 AS b, p_size AS edge FROM part)
SELECT gate, CASE WHEN edge > 45 THEN 'other_edge' WHEN b NOT IN (SELECT tri FROM tris) THEN 'missing_target' WHEN a = b THEN 'self' WHEN EXISTS (SELECT 1 FROM near WHERE near.a = g.a AND near.b = g.b) THEN 'reached_without' ELSE 'verified' END AS reason FROM g""")
def g17_gateway_reasons(spark, d):
    """Gateways with the first reason against each: another edge, no target, itself, a target reached without it; or verified."""
    access = _access(spark, d)
    k = F.col("p_partkey")
    g = table(spark, d, "part").select(k.alias("gate"), ((k * 13 + 7) % 260).alias("b"), F.col("p_size").alias("edge"), F.floor(k / 40).alias("field"))
    there = access.select(F.col("tri").alias("b"), F.lit(True).alias("there")).distinct()
    inside = g.join(access.select(F.col("tri").alias("b"), F.col("field").alias("target_field")).distinct(), "b").where("field = target_field AND gate <> b AND edge <= 45")
    # only gates inside a scene can be reached without, so only their starts are walked
    met = network.reach_pairs(access, inside.select("field", F.col("gate").alias("start"), F.col("b").alias("target"))).select(F.col("start").alias("gate"), F.lit(True).alias("reached"))
    j = g.join(there, "b", "left").join(met, "gate", "left")
    reason = F.when(F.col("edge") > 45, "other_edge").when(F.col("there").isNull(), "missing_target").when(F.col("gate") == F.col("b"), "self").when(F.col("reached"), "reached_without").otherwise("verified")
    return j.select("gate", reason.alias("reason"))


@query(_CALLS + """, w(root, callee, depth) AS (SELECT a, b, 1 FROM e UNION SELECT root, b, depth + 1 FROM w JOIN e ON callee = a WHERE depth < 16), o AS (SELECT DISTINCT root, callee FROM w)
SELECT callee AS instruction, count(*) AS owners, min(root) AS first, count(*) = 1 AS exclusive FROM o GROUP BY callee""")
def x6_ownership(spark, d):
    """Entries that reach each instruction: how many, the first, and whether one alone does."""
    k = F.col("p_partkey")
    callees = F.when(k % 3 < 2, F.array(*[50 * F.floor(k / 50) + (k * 5 + s * 17) % 50 for s in range(2)]))
    edges = table(spark, d, "part").select(k.alias("caller"), F.explode(callees).alias("callee")).distinct()
    found = graph.calls(edges, edges.select(F.col("caller").alias("root")).distinct())
    return found.groupBy(F.col("callee").alias("instruction")).agg(F.count("*").alias("owners"), F.min("root").alias("first")).withColumn("exclusive", F.col("owners") == 1)


_RING = """, wo AS (SELECT face, unnest([[(x0 % 5000, z0, h0), (x1 % 5000, z1, h1)], [(x1 % 5000, z1, h1), (x2 % 5000, z2, h2)], [(x2 % 5000, z2, h2), (x0 % 5000, z0, h0)]]) AS e FROM faces WHERE face < 1000000000),
op AS (SELECT least(e[1], e[2]) AS a, greatest(e[1], e[2]) AS b FROM wo GROUP BY ALL HAVING count(*) = 1), ring AS (SELECT * FROM op WHERE a[2] = 0 AND b[2] = 0)"""


@query(FACES + _RING + """, v AS (SELECT p, count(*) AS n FROM (SELECT a AS p FROM ring UNION ALL SELECT b FROM ring) GROUP BY p)
SELECT (SELECT count(*) FROM ring) AS caps, (SELECT count(*) FROM v) AS corners, (SELECT count(*) FROM v WHERE n <> 2) AS loose, (SELECT count(*) FROM op) AS open_before, (SELECT count(*) FROM op) - (SELECT count(*) FROM ring) + (SELECT count(*) FROM v WHERE n = 1) AS open_after""")
def t10_polar_cap(spark, d):
    """A fan of faces from the pole over the open northern ring, and the open edges before and after."""
    f = faces(spark, d).where("face < 1000000000").select("face", "region", *[f"{a}{i}" for i in range(3) for a in "xzh"])
    around = lambda s: s.withColumns({f"x{i}": F.col(f"x{i}") % WIDTH for i in range(3)})
    open_edges = lambda s: topology.occurrences(s).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")
    before = graph.cut(open_edges(around(f)))
    ring = before.where("a.z = 0 AND b.z = 0")
    pole = [F.lit(0).cast("long"), F.lit(-100).cast("long"), F.lit(0).cast("long")]
    ends = [F.col(f"{s}.{a}") for s in "ab" for a in "xzh"]
    caps = ring.select(F.xxhash64("a", "b").alias("face"), F.lit(-1).alias("region"), *[c.alias(n) for c, n in zip([*ends, *pole], [f"{a}{i}" for i in range(3) for a in "xzh"], strict=True)])
    after = open_edges(around(f).unionByName(caps))
    corners = ring.select(F.explode(F.array("a", "b")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    one = lambda df, **x: df.agg(*[v.alias(k) for k, v in x.items()])
    sums = one(ring, caps=F.count("*")).crossJoin(one(corners, corners=F.count("*"), loose=F.coalesce(F.count_if(F.col("n") != 2), F.lit(0)))).crossJoin(one(before, open_before=F.count("*"))).crossJoin(one(after, open_after=F.count("*")))
    return sums  # four tables of one row each


@query(FACES + """ SELECT face, CAST(x0 AS BIGINT) AS x0, CAST(z1 AS BIGINT) AS z1, CAST(h2 AS BIGINT) AS h2, terrain, script, sha256(chr(0)) IS NOT NULL AS whole FROM faces""")
def k3_native_rows(spark, d):
    """Faces written as records of 40 bytes and read back from them."""
    names = [f"{a}{i}" for i in range(3) for a in "xzh"]
    packed = faces(spark, d).select("face", F.unhex(F.concat(*[b.le(F.col(c), 4) for c in names], b.le(F.col("terrain") + 32 * F.col("script"), 1), b.le(F.col("region"), 1), F.lit("0000"))).alias("raw"))
    at = {c: 4 * i for i, c in enumerate(names)}
    flags = b.u8(F.col("raw"), 36)
    return packed.select("face", b.u32(F.col("raw"), at["x0"]).alias("x0"), b.u32(F.col("raw"), at["z1"]).alias("z1"), b.u32(F.col("raw"), at["h2"]).alias("h2"), flags.bitwiseAND(31).alias("terrain"), F.shiftright(flags, 5).alias("script"), (F.length("raw") == 40).alias("whole"))


@query("""WITH a AS (SELECT DISTINCT p_partkey AS s, (p_partkey * 7 + j * 3) % 500 AS t, 1 + (p_partkey + j) % 4 AS w FROM part, range(4) r(j)), n AS (SELECT count(*) AS n FROM part)
SELECT 'self' AS violation, count(*) AS arcs FROM a WHERE s = t UNION ALL SELECT 'unknown_target', count(*) FROM a, n WHERE t >= n UNION ALL SELECT 'no_reverse', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM a r WHERE r.s = a.t AND r.t = a.s AND r.w = a.w)
UNION ALL SELECT 'degree', count(*) FROM (SELECT s FROM a GROUP BY s HAVING count(*) > 3)""")
def s25_graph_violations(spark, d):
    """A graph's arcs against its rules: no loops, known targets, a reverse arc of the same weight, three arcs at most."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    a = part.select(k.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select("s", ((F.col("s") * 7 + F.col("j") * 3) % 500).alias("t"), (1 + (F.col("s") + F.col("j")) % 4).alias("w")).distinct()
    known = part.select(k.alias("t"))
    reverse = a.select(F.col("t").alias("s"), F.col("s").alias("t"), "w")
    count = lambda name, rows: rows.agg(F.count("*").alias("arcs")).select(F.lit(name).alias("violation"), "arcs")
    return count("self", a.where("s = t")).union(count("unknown_target", a.join(known, "t", "left_anti"))).union(count("no_reverse", a.join(reverse, ["s", "t", "w"], "left_anti"))).union(count("degree", a.groupBy("s").count().where("count > 3")))


@query(SURFACES + """, hh AS (SELECT qid, CAST(low_n AS DOUBLE) / low_d AS h, face FROM surfaces WHERE kind IN ('inside', 'boundary')), g AS (SELECT qid, min(face) AS face, min(h) AS lo, max(h) AS hi FROM hh GROUP BY qid)
SELECT qid, CASE WHEN hi - lo > 1e-6 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN hi - lo > 1e-6 THEN -1 ELSE face END AS face, round(CASE WHEN hi - lo > 1e-6 THEN -1 ELSE lo END, 6) AS height FROM g""")
def f20_containing_surface(spark, d):
    """The surface that holds a point; heights more than 1e-6 apart are ambiguous and give none."""
    hits = tin.surfaces_at(faces(spark, d), _surface_points(spark, d)).where("kind IN ('inside', 'boundary')")
    g = hits.withColumn("h", F.expr("double(low_n) / low_d")).groupBy("qid").agg(F.min("face").alias("face"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    many = F.expr("hi - lo > 1e-6")
    return g.select("qid", F.when(many, "ambiguous").otherwise("found").alias("status"), F.when(many, -1).otherwise(F.col("face")).alias("face"), F.round(F.when(many, -1.0).otherwise(F.col("lo")), 6).alias("height"))


_MOVED = SURFACES.replace("q AS (SELECT l_orderkey * 10 + l_linenumber AS qid, (l_partkey * 37 + l_suppkey * 11) % 15000 AS px,", "q0 AS (SELECT l_orderkey * 10 + l_linenumber AS qid, (l_partkey * 137 + l_suppkey * 11) % 54000 - 21000 AS wx,").replace(" AS pz, 3 AS q FROM lineitem),", " AS pz, 3 AS q FROM lineitem),\nq AS (SELECT qid, wx - o * 15000 AS px, pz, q FROM q0, range(-2, 3) t(o) WHERE wx BETWEEN -15000 AND 30000 AND wx - o * 15000 BETWEEN 0 AND 15000),", 1)


@query(_MOVED + """, n AS (SELECT qid, count(*) AS hits, count(DISTINCT (low_n, low_d)) AS heights FROM surfaces WHERE kind IN ('inside', 'boundary') GROUP BY qid)
SELECT q0.qid, CASE WHEN wx NOT BETWEEN -15000 AND 30000 THEN 'outside_domain' WHEN hits IS NULL THEN 'no_surface' ELSE 'ok' END AS status, coalesce(hits, 0) AS hits, coalesce(heights, 0) AS heights FROM q0 LEFT JOIN n USING (qid)""")
def v8_periodic_points(spark, d):
    """Points over a surface that repeats to either side, within a domain of one width around it."""
    li = table(spark, d, "lineitem")
    own = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qid"), ((F.col("l_partkey") * 137 + F.col("l_suppkey") * 11) % 54000 - 21000).alias("wx"), ((F.col("l_partkey") * 53 + F.col("l_linenumber") * 7) % 12000).alias("pz"), F.lit(3).cast("long").alias("q"))
    inside = F.col("wx").between(-3 * WIDTH, 6 * WIDTH)
    # a replica of the surface moved east is a point moved west
    points = own.where(inside).select("qid", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda o: F.col("wx") - o * 3 * WIDTH)).alias("px"), "pz", "q").where(F.col("px").between(0, 3 * WIDTH))
    n = tin.surfaces_at(faces(spark, d), points).where("kind IN ('inside', 'boundary')").groupBy("qid").agg(F.count("*").alias("hits"), F.count_distinct("low_n", "low_d").alias("heights"))
    status = F.when(~inside, "outside_domain").when(F.col("hits").isNull(), "no_surface").otherwise("ok")
    return own.join(n, "qid", "left").select("qid", status.alias("status"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("heights", F.lit(0)).alias("heights"))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey % 4 AS form, l_partkey % 1000 - 500 AS n, 1 + l_suppkey % 90 AS d FROM lineitem),
v AS (SELECT k, form = 3 AND abs(n) > 10 AS far, CASE form WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n * 100 + sign(n) * (d % 100) ELSE n * 100000 END AS a, CASE form WHEN 0 THEN d WHEN 1 THEN 1 WHEN 2 THEN 100 ELSE 1 END AS b FROM r)
SELECT k, CASE WHEN far THEN 'invalid' ELSE 'ok' END AS status, CAST(CASE WHEN far THEN 0 ELSE a // gcd(a, b) END AS BIGINT) AS n, CAST(CASE WHEN far THEN 0 ELSE b // gcd(a, b) END AS BIGINT) AS d FROM v""")
def f15_rational_texts(spark, d):
    """Whole numbers, fractions, decimals and exponents as exact ratios in lowest terms."""
    li = table(spark, d, "lineitem")
    n, q, form = F.col("l_partkey") % 1000 - 500, 1 + F.col("l_suppkey") % 90, F.col("l_orderkey") % 4
    s = lambda c: c.cast("string")
    text = F.when(form == 0, F.concat(s(n), F.lit("/"), s(q))).when(form == 1, s(n)).when(form == 2, F.concat(F.when(n == 0, "0").otherwise(s(n)), F.lit("."), F.when(n == 0, "00").otherwise(F.lpad(s(q % 100), 2, "0")))).otherwise(F.concat(s(n), F.lit("e5")))
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), tin.rational(text).alias("r"))
    return rows.select("k", F.when(F.col("r").isNull(), "invalid").otherwise("ok").alias("status"), F.coalesce("r.n", F.lit(0)).alias("n"), F.coalesce("r.d", F.lit(0)).alias("d"))


@query("""WITH p AS (SELECT p_partkey AS k, radians((p_partkey % 36) * 10 - 180.0) AS l, radians((p_partkey % 15) * 8 - 60.0) AS b, radians(4.0) AS w, p_partkey % 7 = 0 AS crossed, p_partkey % 11 = 0 AS twice FROM part),
v AS (SELECT k, crossed, twice, cos(b) * cos(l) AS ax, cos(b) * sin(l) AS ay, sin(b) AS az, cos(b) * cos(l + w) AS bx, cos(b) * sin(l + w) AS by_, sin(b) AS bz, cos(b + w) * cos(l + w) AS cx, cos(b + w) * sin(l + w) AS cy, sin(b + w) AS cz, cos(b + w) * cos(l) AS dx, cos(b + w) * sin(l) AS dy, sin(b + w) AS dz FROM p),
t AS (SELECT k, crossed, twice, 2 * atan2(abs(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)), 1 + ax * bx + ay * by_ + az * bz + bx * cx + by_ * cy + bz * cz + cx * ax + cy * ay + cz * az) AS s, 2 * atan2(abs(ax * (cy * dz - cz * dy) + ay * (cz * dx - cx * dz) + az * (cx * dy - cy * dx)), 1 + ax * cx + ay * cy + az * cz + cx * dx + cy * dy + cz * dz + dx * ax + dy * ay + dz * az) AS u FROM v)
SELECT k, CASE WHEN twice THEN 'repeated_vertex' WHEN crossed THEN 'self_intersecting' ELSE 'ok' END AS status, round(CASE WHEN twice OR crossed THEN 0 ELSE (s + u) * 1e6 END, 4) AS area FROM t""")
def f47_polygon_area(spark, d):
    """Areas of polygons on a sphere of radius 1,000, or the first reason against each."""
    k = F.col("p_partkey")
    lon, lat = (k % 36 * 10 - 180).cast("double"), (k % 15 * 8 - 60).cast("double")
    point = lambda a, c: F.struct(a.alias("lon"), c.alias("lat"))
    corners = [point(lon, lat), point(lon + 4, lat), point(lon + 4, lat + 4), point(lon, lat + 4)]
    ring = F.when(k % 11 == 0, F.array(*corners, corners[1])).when(k % 7 == 0, F.array(corners[0], corners[2], corners[1], corners[3])).otherwise(F.array(*corners))
    found = table(spark, d, "part").select(k.alias("k"), sphere.polygon(ring, 1000.0).alias("p"))
    return found.select("k", F.col("p.status").alias("status"), F.round("p.area", 4).alias("area"))


@query("""WITH p AS (SELECT s_suppkey AS k, (s_suppkey * 37) % 360 - 180.0 AS lon, (s_suppkey * 53) % 160 - 80.0 AS lat FROM supplier), c AS (SELECT k, lon, lat, unnest([0, 1, 2, 3]) AS i FROM p),
v AS (SELECT k, i, sin(radians(20)) * sin(radians(lat + CASE WHEN i >= 2 THEN 9 ELSE 0 END)) + cos(radians(20)) * cos(radians(lat + CASE WHEN i >= 2 THEN 9 ELSE 0 END)) * cos(radians(lon + CASE WHEN i IN (1, 2) THEN 12 ELSE 0 END - 30)) >= 0 AS seen FROM c),
n AS (SELECT k, count(*) FILTER (seen) AS seen, count(*) FILTER (seen <> before) AS cuts FROM (SELECT *, coalesce(lag(seen) OVER (PARTITION BY k ORDER BY i), last_value(seen) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM v) GROUP BY k)
SELECT k, CAST(CASE WHEN seen + cuts >= 3 THEN seen + cuts ELSE 0 END AS BIGINT) AS corners, true AS on_horizon FROM n""")
def f50_horizon_clip(spark, d):
    """Cells clipped to the visible hemisphere; the corners that a cut adds lie on the horizon."""
    s = F.col("s_suppkey")
    lon, lat = (s * 37 % 360 - 180).cast("double"), (s * 53 % 160 - 80).cast("double")
    point = lambda a, c: F.struct(a.alias("lon"), c.alias("lat"))
    ring = F.array(point(lon, lat), point(lon + 12, lat), point(lon + 12, lat + 9), point(lon, lat + 9))
    rows = table(spark, d, "supplier").select(s.alias("k"), sphere.clipped_to_horizon(ring, 30.0, 20.0).alias("c"))
    on = F.forall("c", lambda p: ~p["added"] | (F.abs(sphere.visibility(p["lon"], p["lat"], 30.0, 20.0)) < 1e-9))
    return rows.select("k", F.size("c").cast("long").alias("corners"), on.alias("on_horizon"))


@query("""WITH p AS (SELECT s_suppkey AS k, 0.5 + (s_suppkey * 7919) % 1000 / 20.0 AS px FROM supplier), c AS (SELECT k, px, unnest([90.0, 60, 45, 30, 20, 15, 10, 5, 2, 1, 0.5, 0.25, 0.1]) AS step FROM p), b AS (SELECT k, arg_min(step, (round(abs(ln(step * px / 120)), 12), -step)) AS best FROM c GROUP BY k)
SELECT p.k, CAST(CASE WHEN 30 * px BETWEEN 60 AND 190 THEN 30 ELSE best END AS DOUBLE) AS step FROM p JOIN b USING (k)""")
def f56_graticule_interval(spark, d):
    """Interval of the graticule: the present one while its lines are 60 to 190 pixels apart, else the one nearest to 120."""
    px = 0.5 + (F.col("s_suppkey") * 7919) % 1000 / 20.0
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), sphere.interval(px, 30.0).alias("step"))


@query(FACES + """ SELECT face, CAST(CASE WHEN face >= 3000000000 THEN 2 WHEN face >= 2000000000 THEN 3 WHEN face % 2 = 1 AND face < 1000000000 THEN 3 ELSE 4 END AS INTEGER) AS corners, CASE WHEN face >= 2000000000 THEN 0.0 WHEN face % 2 = 1 AND face < 1000000000 THEN 1250.0 ELSE 3750.0 END AS area FROM faces""")
def f23_half_plane_clip(spark, d):
    """Faces cut off half a cell east of their west side, with heights along the cut."""
    f = tin.metrics(faces(spark, d))
    ring = F.array(*[F.struct(*[F.col(f"{a}{i}").cast("double").alias(a) for a in "xzh"]) for i in range(3)])
    cut = f.select("face", tin.clipped(ring, "x", F.col("minx") + 50.0).alias("c"))
    return cut.select("face", F.size("c").alias("corners"), F.abs(tin.ring_area("c")).alias("area"))


@query(FACES + """, p AS (SELECT l_orderkey * 10 + l_linenumber AS k, f.*, x0 + (l_partkey * 7) % 130 - 10 AS px, z0 + (l_suppkey * 11) % 130 - 10 AS pz FROM lineitem JOIN faces f ON face = 2 * l_partkey + CASE WHEN l_linenumber = 3 AND l_partkey % 107 = 0 THEN 3000000000 ELSE 0 END),
w AS (SELECT *, (x2 - x1) * (pz - z1) - (z2 - z1) * (px - x1) AS a, (x0 - x2) * (pz - z2) - (z0 - z2) * (px - x2) AS b, (x1 - x0) * (pz - z0) - (z1 - z0) * (px - x0) AS c FROM p)
SELECT k, CASE WHEN det = 0 THEN 'degenerate' WHEN a * sign(det) < 0 OR b * sign(det) < 0 OR c * sign(det) < 0 THEN 'outside' WHEN a = 0 OR b = 0 OR c = 0 THEN 'boundary' ELSE 'inside' END AS status, round(CASE WHEN det = 0 THEN 0 ELSE (a * h0 + b * h1 + c * h2) / CAST(det AS DOUBLE) END, 6) + 0.0 AS height FROM w""")
def f19_local_points(spark, d):
    """Points against a stated triangle by whole numbers, with the height of its plane there."""
    li = table(spark, d, "lineitem")
    p = F.col("l_partkey")
    face = 2 * p + F.when((F.col("l_linenumber") == 3) & (p % 107 == 0), 3_000_000_000).otherwise(0)
    own = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), face.alias("face"), ((p * 7) % 130 - 10).alias("dx"), ((F.col("l_suppkey") * 11) % 130 - 10).alias("dz"))
    met = tin.metrics(faces(spark, d)).join(own, "face").withColumns({"px": F.col("x0") + F.col("dx"), "pz": F.col("z0") + F.col("dz")})
    turn = lambda i, j: (F.col(f"x{j}") - F.col(f"x{i}")) * (F.col("pz") - F.col(f"z{i}")) - (F.col(f"z{j}") - F.col(f"z{i}")) * (F.col("px") - F.col(f"x{i}"))
    met = met.withColumns({"a": turn(1, 2), "b": turn(2, 0), "c": turn(0, 1)})
    side = F.signum("det")
    status = F.when(F.col("det") == 0, "degenerate").when(F.least(F.col("a") * side, F.col("b") * side, F.col("c") * side) < 0, "outside").when(F.expr("a = 0 OR b = 0 OR c = 0"), "boundary").otherwise("inside")
    height = F.when(F.col("det") == 0, 0.0).otherwise(F.expr("(a * h0 + b * h1 + c * h2) / CASE WHEN det <> 0 THEN det END"))
    return met.select("k", status.alias("status"), (F.round(height, 6) + 0.0).alias("height"))
