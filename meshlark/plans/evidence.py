"""Queries that relate evidence: integrity, ownership, coverage, versions of a surface, decoded fields."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.operators import graph, ordered, tin, topology, variant
from meshlark.plans.catalog import _PLACES, EDGES, FACES, _places, _recursive, query
from meshlark.sources.tables import WIDTH, faces, table

_SETS = FACES + """, rule AS (SELECT f.*, CASE terrain WHEN 16 THEN 0 WHEN 24 THEN 8 ELSE terrain END AS t, least(region, 15) AS r FROM faces f),
slots AS (SELECT r, s, (r * 5 + s * 7) % 32 AS st FROM range(16) a(r), range(4) b(s)),
hit AS (SELECT face, any_value(region) AS region, any_value(rule.terrain) AS terrain, any_value(abs(det)) AS area2, r || ':' || coalesce(min(s) FILTER (st = t), 0) AS set_id, count(*) FILTER (st = t) = 0 AS fallback FROM rule JOIN slots USING (r) GROUP BY face, r)"""


@query(_SETS + """ SELECT coalesce(region, -1) AS region, coalesce(terrain, -1) AS terrain, coalesce(set_id, '') AS set_id, count(*) AS faces, CAST(sum(area2) AS BIGINT) AS area2, count(*) FILTER (fallback) AS fallbacks, count(*) FILTER (area2 = 0) AS zero_area FROM hit GROUP BY GROUPING SETS ((region), (terrain), (set_id))""")
def a7_encounter_geography(spark, d):
    """Faces and area of every region, terrain and encounter set, each face once."""
    r, t = F.least("region", F.lit(15)), F.when(F.col("terrain") == 16, 0).when(F.col("terrain") == 24, 8).otherwise(F.col("terrain"))
    at = F.array_position(F.array(*[(r * 5 + s * 7) % 32 for s in range(4)]), t)
    rows = tin.metrics(faces(spark, d)).dropDuplicates(["face"]).select("region", "terrain", "area2", F.concat_ws(":", r.cast("string"), F.greatest(at - 1, F.lit(0)).cast("string")).alias("set_id"), (at == 0).alias("fallback"))
    sets = rows.groupingSets([["region"], ["terrain"], ["set_id"]], "region", "terrain", "set_id")
    return sets.agg(F.count("*").alias("faces"), F.sum("area2").alias("area2"), F.count_if("fallback").alias("fallbacks"), F.count_if(F.col("area2") == 0).alias("zero_area")).fillna(-1, ["region", "terrain"]).fillna("", ["set_id"])


@query(_PLACES + """, i AS (SELECT s_nationkey, CAST((s_suppkey * 137) % 360 AS BIGINT) AS lo, CAST((s_suppkey * 137) % 360 + 5 + s_suppkey % 30 AS BIGINT) AS hi FROM supplier),
o AS (SELECT *, max(hi) OVER (PARTITION BY s_nationkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
g AS (SELECT s_nationkey, lo - b AS gap, lo AS s, b AS e FROM o WHERE b < lo UNION ALL SELECT s_nationkey, min(lo) + 360 - max(hi), min(lo), max(hi) FROM i GROUP BY s_nationkey),
m AS (SELECT s_nationkey, max((gap, s, e)) AS x FROM g GROUP BY s_nationkey)
SELECT s_nationkey, x[2] % 360 AS arc_start, x[3] % 360 AS arc_end, 360 - x[1] AS arc_length, x[1] > 0 AND x[2] > x[3] AS wraps FROM m""")
def a5_circular_span(spark, d):
    """Smallest arc of longitudes that covers each nation's extents."""
    s = F.col("s_suppkey")
    lo = (s * 137) % 360
    return ordered.circular_span(table(spark, d, "supplier").select("s_nationkey", lo.alias("lo"), (lo + 5 + s % 30).alias("hi")), "s_nationkey", "lo", "hi", 360)


@query("""SELECT l_orderkey, l_linenumber, coalesce(max(CASE WHEN l_linenumber = 1 OR l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING), -1) AS leader FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)""")
def w11_block_leaders(spark, d):
    """The first instruction of the basic block of each (lines of an order as code), -1 without one."""
    code = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f")).withColumn("leads", F.expr("l_linenumber = 1 OR f = 'R'"))
    return ordered.block_leaders(code, "l_orderkey", "l_linenumber", "leads").select("l_orderkey", "l_linenumber", F.coalesce("leader", F.lit(-1)).alias("leader"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, l_returnflag AS f FROM lineitem)
SELECT k, count(*) FILTER (s % 10 = 3 AND f = 'R') AS owners FROM l GROUP BY k HAVING count(*) FILTER (s % 10 = 3 AND f = 'R') > 0""")
def p11_same_owner(spark, d):
    """Records of which one and the same owner meets all conditions."""
    records = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_suppkey", "l_returnflag").alias("owner")).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("owner").alias("owners"))
    meets = lambda o: (o["l_suppkey"] % 10 == 3) & (o["l_returnflag"] == "R")
    return records.where(F.exists("owners", meets)).select("k", F.size(F.filter("owners", meets)).cast("long").alias("owners"))


_LINKS = "WITH rec AS (SELECT o_orderkey AS k, o_custkey % 7 AS w FROM orders WHERE o_orderkey % 11 <> 0), link AS (SELECT o_orderkey AS k, o_custkey % 7 AS w FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT o_orderkey, o_custkey % 7 FROM orders WHERE o_orderkey % 17 = 0)"


@query(_LINKS + """, a AS (SELECT k, count(*) AS n, max(w) AS w FROM rec GROUP BY k), b AS (SELECT k, count(*) AS m, min(w) AS v FROM link GROUP BY k),
s AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN n IS NULL THEN 'extra' WHEN m IS NULL THEN 'missing' WHEN n > 1 OR m > 1 THEN 'repeated' WHEN w <> v THEN 'conflict' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.k = b.k)
SELECT status, count(*) AS records, (SELECT count(*) FROM s WHERE status <> 'matched') = 0 AS accepted FROM s GROUP BY status""")
def j6_total_bijection(spark, d):
    """Records and links that must pair off completely, or none is accepted."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7).alias("w"))
    rec = o.where("k % 11 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    link = o.where("k % 13 <> 0").union(o.where("k % 17 = 0")).groupBy("k").agg(F.count("*").alias("m"), F.min("w").alias("v"))
    status = F.when(F.col("n").isNull(), "extra").when(F.col("m").isNull(), "missing").when(F.expr("n > 1 OR m > 1"), "repeated").when(F.expr("w <> v"), "conflict").otherwise("matched")
    found = rec.join(link, "k", "full").groupBy(status.alias("status")).agg(F.count("*").alias("records"))
    # five rows at most
    return found.withColumn("accepted", F.sum(F.when(F.col("status") != "matched", F.col("records")).otherwise(0)).over(Window.partitionBy()) == 0)


@query("""WITH t AS (SELECT o_orderkey // 2 AS gate, o_orderpriority AS target FROM orders) SELECT gate, count(*) AS copies, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, CASE WHEN count(DISTINCT target) = 1 THEN 'unique' ELSE 'conflict' END AS status FROM t GROUP BY gate""")
def j18_transitions(spark, d):
    """Copies of a transition are one; copies with other targets are a conflict and give none."""
    t = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 2).alias("gate")).agg(F.count("*").alias("copies"), F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi"))
    one = F.col("lo") == F.col("hi")
    return t.select("gate", "copies", F.when(one, F.col("lo")).alias("target"), F.when(one, "unique").otherwise("conflict").alias("status"))


@query("""WITH r AS (SELECT event_id, user_id % 977 AS actor, CAST(event_id % 9 AS INTEGER) AS entry FROM events WHERE event_type = 'click'), t AS (SELECT p_partkey % 977 AS actor, p_size % 9 AS entry, p_partkey AS target FROM part), c AS (SELECT actor, entry, count(DISTINCT target) AS n, min(target) AS target FROM t GROUP BY ALL)
SELECT event_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, coalesce(CASE WHEN n = 1 THEN target END, -1) AS target FROM r LEFT JOIN c USING (actor, entry)""")
def j26_requests(spark, d):
    """Requests to the entry tables of actors: resolved, ambiguous or missing."""
    r = table(spark, d, "events").where("event_type = 'click'").select("event_id", (F.col("user_id") % 977).alias("actor"), (F.col("event_id") % 9).cast("int").alias("entry"))
    t = table(spark, d, "part").groupBy((F.col("p_partkey") % 977).alias("actor"), (F.col("p_size") % 9).alias("entry")).agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    status = F.when(F.col("lo").isNull(), "missing").when(F.expr("lo <> hi"), "ambiguous").otherwise("resolved")
    return r.join(t, ["actor", "entry"], "left").select("event_id", status.alias("status"), F.when(F.expr("lo = hi"), F.col("lo")).otherwise(-1).alias("target"))


@query("""SELECT c_nationkey AS field, count(*) AS entrances, count(DISTINCT c_mktsegment) AS locations, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN 'verified_direct' WHEN count(DISTINCT c_mktsegment) > 4 THEN 'unresolved' ELSE 'ambiguous' END AS status, min(c_custkey) AS first, arg_min(c_mktsegment, c_custkey) AS first_location, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS names FROM customer GROUP BY c_nationkey""")
def a15_locations(spark, d):
    """Entrances grouped into places, with the first of each and how sure the place is."""
    n = F.count_distinct("c_mktsegment")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("field")).agg(F.count("*").alias("entrances"), n.alias("locations"), F.min("c_custkey").alias("first"), F.min_by("c_mktsegment", "c_custkey").alias("first_location"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("names"))
    return c.withColumn("status", F.when(F.col("locations") == 1, "verified_direct").when(F.col("locations") > 4, "unresolved").otherwise("ambiguous"))


@query("""WITH a AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS bank, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS bank, count(*) AS m FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT user_id, bank, n * m AS candidates FROM a JOIN b USING (user_id, bank)""")
def j28_candidates(spark, d):
    """Candidate pairs of questions and tests of the same variable, counted without forming them."""
    e = table(spark, d, "events").withColumn("bank", F.get_json_object("props", "$.k").cast("int")).groupBy("user_id", "bank").agg(F.count_if(F.col("event_type") == "click").alias("n"), F.count_if(F.col("event_type") == "view").alias("m"))
    return e.where("n > 0 AND m > 0").select("user_id", "bank", (F.col("n") * F.col("m")).alias("candidates"))


_OTHER = FACES + """, alt AS (SELECT face, x1 AS x0, z1 AS z0, h1 AS h0, x2 AS x1, z2 AS z1, h2 AS h1, x0 AS x2, z0 AS z2, h0 AS h2, CASE WHEN face % 5 = 0 THEN 31 ELSE terrain END AS terrain, script, det FROM faces WHERE face % 7 <> 0 AND face % 4 <> 2
  UNION ALL SELECT face, x1, z1, h1, x0, z0, h0, x2, z2, h2, terrain, script, -det FROM faces WHERE face % 7 <> 0 AND face % 4 = 2 UNION ALL SELECT face, x0, z0, h0 + 1, x1, z1, h1, x2, z2, h2, terrain, script, det FROM faces WHERE face % 7 = 0),
u AS (SELECT 1 AS b, 0 AS o, x0, z0, h0, x1, z1, h1, x2, z2, h2, terrain, script, abs(det) AS area2 FROM faces UNION ALL SELECT 0, 1, x0, z0, h0, x1, z1, h1, x2, z2, h2, terrain, script, abs(det) FROM alt),
s AS (SELECT *, list_sort([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)]) AS g, least([(x0, z0, h0), (x1, z1, h1), (x2, z2, h2)], [(x1, z1, h1), (x2, z2, h2), (x0, z0, h0)], [(x2, z2, h2), (x0, z0, h0), (x1, z1, h1)]) AS w FROM u)"""


def _other(spark, d):
    """The surface with turned, flipped, moved and repainted faces."""
    f = faces(spark, d)
    names = [f"{a}{i}" for i in range(3) for a in "xzh"]
    turned = lambda order: [F.col(f"{a}{j}").alias(f"{a}{i}") for i, j in enumerate(order) for a in "xzh"]
    rest = ["region", "script", "chocobo"]
    same = f.where("face % 7 <> 0 AND face % 4 <> 2").select("face", *turned((1, 2, 0)), F.when(F.col("face") % 5 == 0, 31).otherwise(F.col("terrain")).alias("terrain"), *rest)
    flipped = f.where("face % 7 <> 0 AND face % 4 = 2").select("face", *turned((1, 0, 2)), "terrain", *rest)
    moved = f.where("face % 7 = 0").withColumn("h0", F.col("h0") + 1).select("face", *names, "terrain", *rest)
    return same.union(flipped).union(moved)


@query(_OTHER + """, c AS (SELECT g, CAST(sum(b) AS BIGINT) AS base_n, CAST(sum(o) AS BIGINT) AS other_n FROM s GROUP BY g),
k1 AS (SELECT g, CAST(sum(n) AS BIGINT) AS winding_common FROM (SELECT g, least(sum(b), sum(o)) AS n FROM s GROUP BY g, w) GROUP BY g), k2 AS (SELECT g, CAST(sum(n) AS BIGINT) AS attribute_common FROM (SELECT g, least(sum(b), sum(o)) AS n FROM s GROUP BY g, terrain, script) GROUP BY g),
k3 AS (SELECT g, CAST(sum(n) AS BIGINT) AS attribute_winding_common FROM (SELECT g, least(sum(b), sum(o)) AS n FROM s GROUP BY g, terrain, script, w) GROUP BY g)
SELECT CASE WHEN least(base_n, other_n) > 0 THEN 'common' WHEN base_n > 0 THEN 'base_only' ELSE 'alternative_only' END AS status, count(*) AS buckets, CAST(sum(base_n) AS BIGINT) AS base_faces, CAST(sum(other_n) AS BIGINT) AS other_faces, CAST(sum(least(base_n, other_n)) AS BIGINT) AS common, count(*) FILTER (base_n > 1 OR other_n > 1) AS ambiguous,
  CAST(sum(winding_common) AS BIGINT) AS winding_common, CAST(sum(attribute_common) AS BIGINT) AS attribute_common, CAST(sum(attribute_winding_common) AS BIGINT) AS attribute_winding_common FROM c JOIN k1 USING (g) JOIN k2 USING (g) JOIN k3 USING (g) GROUP BY 1""")
def v2_variant_buckets(spark, d):
    """Two versions of the surface by buckets of equal geometry."""
    total = lambda c: F.sum(c).alias({"base_n": "base_faces", "other_n": "other_faces"}.get(c, c))
    return variant.buckets(faces(spark, d), _other(spark, d)).groupBy("status").agg(F.count("*").alias("buckets"), F.count_if("ambiguous").alias("ambiguous"), *[total(c) for c in ("base_n", "other_n", "common", *variant.KINDS)])


@query(_OTHER + " SELECT terrain, CAST(sum(b) AS BIGINT) AS base_faces, CAST(sum(o) AS BIGINT) AS other_faces, CAST(sum((o - b) * area2) AS BIGINT) AS area2_delta FROM s GROUP BY terrain")
def v2_variant_terrain(spark, d):
    return variant.by_terrain(faces(spark, d), _other(spark, d))


@query(EDGES + """, c AS (SELECT x0 % 5000 AS x, z0 % 4000 AS z, h0 AS h FROM faces UNION SELECT x1 % 5000, z1 % 4000, h1 FROM faces UNION SELECT x2 % 5000, z2 % 4000, h2 FROM faces),
w AS (SELECT DISTINCT least((a[1] % 5000, a[2] % 4000, a[3]), (b[1] % 5000, b[2] % 4000, b[3])) AS p, greatest((a[1] % 5000, a[2] % 4000, a[3]), (b[1] % 5000, b[2] % 4000, b[3])) AS q FROM edges), n AS (SELECT count(*) AS v FROM c), m AS (SELECT count(*) AS e FROM w WHERE p <> q), k AS (SELECT count(*) AS f FROM faces)
SELECT v AS vertices, e AS edges, f AS faces, v - e + f AS euler FROM n, m, k""")
def t7_weld(spark, d):
    """Positions and edges welded in both directions, and the Euler characteristic."""
    f = faces(spark, d)
    at = lambda x, z, h: F.struct((x % WIDTH).alias("x"), (z % 4000).alias("z"), h.alias("h"))
    corners = F.array(*[at(F.col(f"x{i}"), F.col(f"z{i}"), F.col(f"h{i}")) for i in range(3)])
    v = f.select(F.explode(corners).alias("p")).distinct().agg(F.count("*").alias("vertices"))
    ends = [at(F.col(f"{s}.x"), F.col(f"{s}.z"), F.col(f"{s}.h")) for s in "ab"]
    e = topology.occurrences(f).select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).where("p <> q").distinct().agg(F.count("*").alias("edges"))
    # three tables of one row each
    n = v.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").join(f.agg(F.count("*").alias("faces"), F.lit(1).alias("one")), "one")
    return n.select("vertices", "edges", "faces", (F.col("vertices") - F.col("edges") + F.col("faces")).alias("euler"))


@query(_recursive(EDGES) + """, trig AS (SELECT face FROM faces WHERE script = 3), tie AS (SELECT DISTINCT o.face AS s, p.face AS t FROM occ o JOIN occ p ON o.a = p.a AND o.b = p.b AND o.face <> p.face WHERE o.face IN (SELECT face FROM trig) AND p.face IN (SELECT face FROM trig)),
go(face, here) AS (SELECT face, face FROM trig UNION SELECT go.face, t FROM go JOIN tie ON here = s) SELECT face, min(here) AS label FROM go GROUP BY face""")
def t12_trigger_components(spark, d):
    """Components of trigger faces that share edges."""
    f = faces(spark, d).where("script = 3")
    occ = topology.occurrences(f.select("face", *[f"{a}{i}" for i in range(3) for a in "xzh"]))
    # chained by the edge's smallest face, so an edge of many faces gives no pairs
    least = occ.groupBy("a", "b").agg(F.min("face").alias("least"))
    links = occ.join(least, ["a", "b"]).select(F.col("least").alias("src"), F.col("face").alias("dst"))
    return graph.components(f.select(F.col("face").alias("node")).distinct(), links).select(F.col("node").alias("face"), "label")


@query("""WITH r AS (SELECT l_orderkey AS component, l_suppkey % 4 AS station FROM lineitem) SELECT component, count(*) AS entries FROM r GROUP BY component HAVING count(DISTINCT station) = 4""")
def u7_common_components(spark, d):
    """Components in which all four stations have a place."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("component")).agg(F.count("*").alias("entries"), F.count_distinct(F.col("l_suppkey") % 4).alias("n"))
    return r.where("n = 4").select("component", "entries")


@query("""WITH r AS (SELECT event_id, CAST(value * 1000 AS BIGINT) & 65535 AS packed FROM events) SELECT event_id, CAST(packed & 1023 AS INTEGER) AS scene, CAST(packed >> 10 AS INTEGER) AS weight FROM r WHERE packed >> 10 > 0""")
def f72_packed_records(spark, d):
    """Scene and weight of packed records; records without weight go."""
    packed = F.floor(F.col("value") * 1000 + 0.5).cast("long").bitwiseAND(65535)
    return table(spark, d, "events").select("event_id", packed.alias("packed")).select("event_id", F.col("packed").bitwiseAND(1023).cast("int").alias("scene"), F.shiftright("packed", 10).cast("int").alias("weight")).where("weight > 0")


@query("""WITH s AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) * 14 AS progress FROM events) SELECT CASE WHEN progress IS NULL THEN 'unknown' WHEN progress < 638 THEN 'state0' WHEN progress < 1000 THEN 'state1' WHEN progress < 1197 THEN 'state2' WHEN progress >= 1199 THEN 'state4' ELSE 'state3' END AS state, count(*) AS saves FROM s GROUP BY 1""")
def p22_save_state(spark, d):
    """World states that saves' progress predicts."""
    p = F.get_json_object("props", "$.k").cast("int") * 14
    state = F.when(p.isNull(), "unknown").when(p < 638, "state0").when(p < 1000, "state1").when(p < 1197, "state2").when(p >= 1199, "state4").otherwise("state3")
    return table(spark, d, "events").groupBy(state.alias("state")).agg(F.count("*").alias("saves"))


@query("SELECT user_id, count(*) FILTER (value < before) AS falls, count(*) FILTER (value = before) AS stays FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id HAVING count(*) FILTER (value < before) > 0")
def w9_monotonicity(spark, d):
    """Places where a sequence that must rise does not."""
    e = table(spark, d, "events").select("user_id", "value", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    return e.groupBy("user_id").agg(F.count_if(F.expr("value < before")).alias("falls"), F.count_if(F.expr("value = before")).alias("stays")).where("falls > 0")


@query(FACES + " SELECT CAST(x0 // 800 AS BIGINT) AS section_x, CAST(z0 // 800 AS BIGINT) AS section_z, count(*) AS faces, count(*) FILTER (terrain = 3) AS ocean, round(100.0 * count(*) FILTER (terrain = 3) / count(*), 6) AS ocean_percent FROM faces GROUP BY ALL")
def a12_ocean_share(spark, d):
    """Share of one terrain in every section of the grid."""
    f = faces(spark, d).groupBy(F.floor(F.col("x0") / 800).alias("section_x"), F.floor(F.col("z0") / 800).alias("section_z")).agg(F.count("*").alias("faces"), F.count_if(F.col("terrain") == 3).alias("ocean"))
    return f.withColumn("ocean_percent", F.round(100.0 * F.col("ocean") / F.col("faces"), 6))


@query(FACES + """, e AS (SELECT z0 AS lo, z2 AS hi, terrain, x0 FROM faces WHERE x0 = 0 AND x2 = 0 AND z0 <> z2 UNION ALL SELECT z1, z2, terrain, x1 FROM faces WHERE x1 = 5000 AND x2 = 5000 AND z1 <> z2 UNION ALL SELECT z0, z1, terrain, 0 FROM faces WHERE x0 = 0 AND x1 = 0 AND z0 <> z1 UNION ALL SELECT z1, z2, terrain, 0 FROM faces WHERE x1 = 0 AND x2 = 0 AND z1 <> z2 UNION ALL SELECT z0, z2, terrain, 5000 FROM faces WHERE x0 = 5000 AND x2 = 5000 AND z0 <> z2 UNION ALL SELECT z0, z1, terrain, 5000 FROM faces WHERE x0 = 5000 AND x1 = 5000 AND z0 <> z1),
k AS (SELECT least(lo, hi) AS lo, greatest(lo, hi) AS hi, count(*) FILTER (x0 = 0) AS w, count(*) FILTER (x0 = 5000) AS e, max(terrain) FILTER (x0 = 0) AS tw, max(terrain) FILTER (x0 = 5000) AS te FROM e GROUP BY 1, 2)
SELECT CASE WHEN w = 0 OR e = 0 THEN 'unmatched' WHEN w > 1 OR e > 1 THEN 'ambiguous' ELSE 'unique' END AS status, count(*) AS segments, count(*) FILTER (w = 1 AND e = 1 AND tw = te) AS terrain_equal FROM k GROUP BY 1""")
def a26_boundary_agreement(spark, d):
    """Attributes of segments that match across the seam, ambiguous ones counted apart."""
    occ = topology.occurrences(faces(spark, d)).where(f"a.x = b.x AND a.x IN (0, {WIDTH}) AND a.z <> b.z")
    west = F.col("a.x") == 0
    k = occ.groupBy(F.least("a.z", "b.z").alias("lo"), F.greatest("a.z", "b.z").alias("hi")).agg(F.count_if(west).alias("w"), F.count_if(~west).alias("e"), F.max(F.when(west, F.col("terrain"))).alias("tw"), F.max(F.when(~west, F.col("terrain"))).alias("te"))
    status = F.when(F.expr("w = 0 OR e = 0"), "unmatched").when(F.expr("w > 1 OR e > 1"), "ambiguous").otherwise("unique")
    return k.groupBy(status.alias("status")).agg(F.count("*").alias("segments"), F.count_if(F.expr("w = 1 AND e = 1 AND tw = te")).alias("terrain_equal"))
