"""Queries over networks: scenes of directed slots, routes, calls, control dependence."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.operators import cfg, graph, network, ordered
from meshlark.plans.catalog import _ARCS, EDGES, _arcs, _recursive, query
from meshlark.sources.tables import table

#: Three slots for each part; forty parts are a scene.  Arcs, closure of each scene.
_SCENES = """WITH RECURSIVE slots AS (SELECT p_partkey // 40 AS field, p_partkey AS tri, s AS slot, CASE WHEN (p_partkey * 3 + s) % 5 >= 3 THEN 40 * (p_partkey // 40) + (p_partkey * 7 + s * 11 + (p_partkey * s) % 5) % 40 END AS d FROM part, range(3) t(s)),
tris AS (SELECT DISTINCT field, tri FROM slots), arcs AS (SELECT DISTINCT field, slots.tri AS s, d AS t FROM slots JOIN tris USING (field) WHERE d = tris.tri),
near(field, a, b) AS (SELECT field, tri, tri FROM tris UNION SELECT near.field, a, t FROM near JOIN arcs ON b = s),
wide(field, a, b) AS (SELECT field, tri, tri FROM tris UNION SELECT wide.field, a, t FROM wide JOIN (SELECT s, t FROM arcs UNION SELECT t, s FROM arcs) ON b = s)"""


def _access(spark, d):
    k, s = F.col("p_partkey"), F.col("slot")
    slots = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot"))
    field = F.floor(k / 40)
    dst = F.when((k * 3 + s) % 5 >= 3, 40 * field + (k * 7 + s * 11 + (k * s) % 5) % 40)
    return slots.select(field.alias("field"), k.alias("tri"), "slot", dst.alias("dst"))


@query(_SCENES + """, s AS (SELECT x.field, x.a AS tri, min(x.b) AS strong FROM near x JOIN near y ON x.a = y.b AND x.b = y.a GROUP BY ALL), w AS (SELECT a AS tri, min(b) AS weak FROM wide GROUP BY a) SELECT field, tri, weak, strong FROM s JOIN w USING (tri)""")
def g9_scene_components(spark, d):
    """Weak and strong components of every scene."""
    return network.components(_access(spark, d))


@query(_SCENES + """, walk(field, tri, level) AS (SELECT field, min(tri), 0 FROM tris GROUP BY field UNION SELECT walk.field, t, level + 1 FROM walk JOIN arcs ON tri = s WHERE level < 40),
l AS (SELECT tri, min(level) AS level FROM walk GROUP BY tri), first AS (SELECT field, min(tri) AS start FROM tris GROUP BY field), w AS (SELECT f.start, b AS tri FROM wide JOIN first f ON a = f.start)
SELECT x.field, x.tri, coalesce(level, -1) AS level, CASE WHEN level IS NOT NULL THEN 'reached' WHEN w.tri IS NULL THEN 'different_wcc' ELSE 'direction' END AS status FROM tris x LEFT JOIN l USING (tri) LEFT JOIN w USING (tri)""")
def g10_scene_reach(spark, d):
    """Steps from each scene's first triangle, or why there is no way."""
    access = _access(spark, d)
    starts = access.groupBy("field").agg(F.min("tri").alias("start"))
    c = network.components(access)
    r = network.reach(access, starts).select("tri", "level")
    own = c.join(starts, "field").join(c.select(F.col("tri").alias("start"), F.col("weak").alias("start_weak")), "start").join(r, "tri", "left")
    status = F.when(F.col("level").isNotNull(), "reached").when(F.col("weak") != F.col("start_weak"), "different_wcc").otherwise("direction")
    return own.select("field", "tri", F.coalesce("level", F.lit(-1)).alias("level"), status.alias("status"))


@query(_SCENES + """, e AS (SELECT field, tri, slot, d, d = tri AS self, NOT EXISTS (SELECT 1 FROM slots r WHERE r.tri = slots.d AND r.d = slots.tri) AS lone, d NOT IN (SELECT tri FROM tris) AS dangling FROM slots WHERE d IS NOT NULL)
SELECT field, count(*) AS arcs, count(*) FILTER (self) AS self, count(*) FILTER (lone AND NOT self AND NOT dangling) AS asymmetric, count(*) FILTER (dangling) AS dangling FROM e GROUP BY field""")
def g12_access_evidence(spark, d):
    """Arcs of each scene to themselves, without a way back, and to no triangle."""
    access = _access(spark, d)
    arcs = access.where("dst IS NOT NULL")
    back = arcs.select(F.col("dst").alias("tri"), F.col("tri").alias("dst"), F.lit(True).alias("back")).distinct()
    there = access.select(F.col("tri").alias("dst"), F.lit(True).alias("there")).distinct()
    e = arcs.join(back, ["tri", "dst"], "left").join(there, "dst", "left")
    own = F.col("dst") == F.col("tri")
    return e.groupBy("field").agg(F.count("*").alias("arcs"), F.count_if(own).alias("self"), F.count_if(F.expr("back IS NULL AND there") & ~own).alias("asymmetric"), F.count_if(F.expr("there IS NULL")).alias("dangling"))


@query(_SCENES + """, gates AS (SELECT p_partkey AS a, p_partkey // 40 AS f, (p_partkey * 13 + 40) % (SELECT count(*) FROM part) AS b FROM part WHERE p_partkey % 2 = 1),
trip(field, tri, n) AS (SELECT 0, 1, 0 UNION SELECT g.b // 40, g.b, n + 1 FROM trip JOIN near ON near.a = trip.tri JOIN gates g ON g.a = near.b WHERE n < 3)
SELECT field, tri, min(n) AS transfers FROM trip GROUP BY ALL""")
def g16_cross_scene_reach(spark, d):
    """Entries within three transfers of a triangle, each with the fewest."""
    part = table(spark, d, "part")
    n = part.count()
    to = (F.col("p_partkey") * 13 + 40) % n
    gates = part.where("p_partkey % 2 = 1").select(F.floor(F.col("p_partkey") / 40).alias("from_field"), F.col("p_partkey").alias("from_tri"), F.floor(to / 40).alias("to_field"), to.alias("to_tri"))
    return network.transfers(_access(spark, d), gates, 0, 1)


@query(_recursive(EDGES) + _ARCS + """, walk(node, dist) AS (SELECT 20, 0 UNION SELECT t, dist + w FROM walk JOIN arcs ON node = s WHERE dist + w <= 40), k AS (SELECT node, min(dist) AS dist FROM walk GROUP BY node),
up AS (SELECT t, min(s) AS p FROM arcs JOIN k x ON x.node = s JOIN k y ON y.node = t WHERE x.dist + w = y.dist GROUP BY t), goal AS (SELECT arg_min(node, (dist, node)) AS node FROM k WHERE node IN (26, 28)),
way(node) AS (SELECT node FROM goal UNION SELECT p FROM way JOIN up ON t = node)
SELECT CAST(row_number() OVER (ORDER BY dist) - 1 AS INTEGER) AS seq, node, CAST(dist AS BIGINT) AS distance FROM way JOIN k USING (node)""")
def g2_route(spark, d):
    """The shortest route from a station to the nearer of two, in order."""
    starts, targets = spark.createDataFrame([(20,)], "node long"), spark.createDataFrame([(26,), (28,)], "node long")
    way = graph.route(_arcs(spark, d), starts, targets)
    # distances along a route differ, as weights are positive
    seq = ordered.offsets(way.select("distance", F.lit(1).cast("long").alias("one")), "distance", "one").select("distance", F.col("offset").cast("int").alias("seq"))
    return way.join(seq, "distance").select("seq", "node", "distance")


@query(EDGES + _ARCS + """, step AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey * 2 AS s, l_partkey * 2 + 1 + l_linenumber % 2 AS t FROM lineitem) SELECT seq, step.s AS src, step.t AS dst FROM step WHERE NOT EXISTS (SELECT 1 FROM arcs a WHERE a.s = step.s AND a.t = step.t)""")
def g7_invalid_steps(spark, d):
    """Steps of given routes that the graph doesn't have."""
    steps = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1 + F.col("l_linenumber") % 2).alias("dst"))
    own = graph.cut(_arcs(spark, d))
    return graph.invalid_steps(steps.join(own, ["src", "dst"], "left"), own).select("seq", "src", "dst")


#: Programs of fifty functions; two in three call two others.
_CALLS = "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, 50 * (p_partkey // 50) + (p_partkey * 5 + s * 17) % 50 AS b FROM part, range(2) t(s) WHERE p_partkey % 3 < 2)"


@query(_CALLS + """, w(root, callee, depth) AS (SELECT a, b, 1 FROM e UNION SELECT root, b, depth + 1 FROM w JOIN e ON callee = a WHERE depth < 16) SELECT root, callee, min(depth) AS depth, root = callee AS cycle FROM w GROUP BY root, callee""")
def g19_calls(spark, d):
    """What each function calls within sixteen calls, and whether it calls itself."""
    k = F.col("p_partkey")
    callees = F.when(k % 3 < 2, F.array(*[50 * F.floor(k / 50) + (k * 5 + s * 17) % 50 for s in range(2)]))
    edges = table(spark, d, "part").select(k.alias("caller"), F.explode(callees).alias("callee")).distinct()
    return graph.calls(edges, edges.select(F.col("caller").alias("root")).distinct()).withColumn("cycle", F.expr("root = callee"))


#: Acyclic scripts of twenty instructions: a node leads to the next, every third also further on.
_SCRIPTS = """WITH RECURSIVE n AS (SELECT p_partkey // 20 AS root, p_partkey % 20 AS i, p_partkey AS k FROM part), sz AS (SELECT root, max(i) AS last FROM n GROUP BY root),
e AS (SELECT root, i AS a, least(last, i + 1 + k % 2) AS b FROM n JOIN sz USING (root) WHERE i < last UNION SELECT root, i, least(last, i + 2 + k % 5) FROM n JOIN sz USING (root) WHERE i < last AND k % 3 = 0),
live(root, a) AS (SELECT root, 0 FROM sz UNION SELECT e.root, b FROM live JOIN e USING (root, a)),
le AS (SELECT e.* FROM e JOIN live USING (root, a)),
miss(root, x, a) AS (SELECT l.root, l.a, 0 FROM live l WHERE l.a <> 0 UNION SELECT e.root, x, b FROM miss m JOIN le e ON e.root = m.root AND e.a = m.a WHERE b <> x),
past(root, x, a) AS (SELECT l.root, l.a, last FROM live l JOIN sz ON sz.root = l.root WHERE l.a <> last UNION SELECT e.root, x, e.a FROM past p JOIN le e ON e.root = p.root AND e.b = p.a WHERE e.a <> x)"""


@query(_SCRIPTS + """, br AS (SELECT root, a FROM le GROUP BY ALL HAVING count(DISTINCT b) > 1),
pd AS (SELECT l.root, l.a AS x, m.a AS of FROM live l JOIN live m USING (root) WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.root = l.root AND p.x = l.a AND p.a = m.a)),
cd AS (SELECT DISTINCT br.root, br.a AS branch, pd.x AS dependent FROM br JOIN le ON le.root = br.root AND le.a = br.a JOIN pd ON pd.root = br.root AND pd.of = le.b WHERE pd.x <> br.a AND NOT EXISTS (SELECT 1 FROM pd q WHERE q.root = br.root AND q.x = pd.x AND q.of = br.a))
SELECT root, branch, dependent, NOT EXISTS (SELECT 1 FROM miss m WHERE m.root = cd.root AND m.x = cd.branch AND m.a = cd.dependent) AS strong FROM cd""")
def x13_control_dependence(spark, d):
    """Standard and strong control dependence in every script."""
    k = F.col("p_partkey")
    n = table(spark, d, "part").select(F.floor(k / 20).alias("root"), (k % 20).alias("i"), k.alias("k"))
    n = n.join(n.groupBy("root").agg(F.max("i").alias("last")), "root")
    nexts = F.when(F.expr("i = last"), F.array(F.lit(None).cast("long"))).otherwise(F.array_compact(F.array(F.least("last", F.col("i") + 1 + F.col("k") % 2), F.when(F.col("k") % 3 == 0, F.least("last", F.col("i") + 2 + F.col("k") % 5)))))
    edges = n.select("root", F.col("i").alias("node"), F.explode(nexts).alias("succ"))
    return cfg.control_dependence(edges, entry=0).where("status = 'ok' AND branch IS NOT NULL").select("root", "branch", "dependent", "strong")
