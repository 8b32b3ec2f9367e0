"""Queries that filter, relate and sum up: attributes of faces, places, entities, evidence and versions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.functions import search
from meshlark.operators import tin, topology
from meshlark.plans.catalog import EDGES, FACES, query
from meshlark.plans.evidence import _OTHER, _other
from meshlark.sources.tables import WIDTH, faces, table

_NAMES = [f"{a}{i}" for i in range(3) for a in "xzh"]

#: Faces with their flags: doubled, without area, degenerate, at an open edge, at an edge of more than two sides.
_FLAGGED = EDGES + """, f AS (SELECT o.face, bool_or(e.incidence = 1) AS boundary, bool_or(e.incidence > 2) AS nonmanifold, bool_or(o.dup) AS duplicate FROM occ o JOIN edges e USING (a, b) GROUP BY o.face),
flagged AS (SELECT x.face, region, terrain, abs(det) AS area2, det = 0 AS zero, degenerate, duplicate, boundary, nonmanifold FROM faces x JOIN bad USING (face) JOIN f USING (face))"""


def _flagged(spark, d):
    own = tin.metrics(faces(spark, d)).select("face", "region", "terrain", "area2", F.col("zero_xz").alias("zero"), F.col("degenerate_3d").alias("degenerate"))
    flags = topology.face_flags(faces(spark, d), WIDTH)
    bit = lambda n: F.col("flags").bitwiseAND(n) != 0
    return own.join(flags, "face").select("face", "region", "terrain", "area2", "zero", "degenerate", bit(topology.DUPLICATE).alias("duplicate"), bit(topology.BOUNDARY).alias("boundary"), bit(topology.NONMANIFOLD).alias("nonmanifold"))


_DIAGNOSTICS = ("zero", "degenerate", "duplicate", "boundary", "nonmanifold")


@query(_FLAGGED + " SELECT 'all' AS filter, count(*) AS faces, CAST(sum(area2) AS BIGINT) AS area2 FROM flagged" + "".join(f" UNION ALL SELECT '{n}', count(*), CAST(coalesce(sum(area2), 0) AS BIGINT) FROM flagged WHERE {n}" for n in _DIAGNOSTICS))
def p5_diagnostic_filters(spark, d):
    """Faces that pass each diagnostic filter, counted in one pass."""
    keys = F.array(F.lit("all"), *[F.when(F.col(n), n) for n in _DIAGNOSTICS])
    found = _flagged(spark, d).select("area2", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("filter")).groupBy("filter").agg(F.count("*").alias("faces"), F.sum("area2").alias("area2"))
    every = spark.createDataFrame([(n,) for n in ("all", *_DIAGNOSTICS)], "filter string")
    return every.join(found, "filter", "left").fillna(0)


@query(_FLAGGED + """, t AS (SELECT terrain, count(*) AS faces, CAST(sum(area2) AS BIGINT) AS area2, count(*) FILTER (zero) AS zero, count(*) FILTER (degenerate) AS degenerate, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (boundary) AS boundary FROM flagged GROUP BY terrain)
SELECT CAST(terrain AS INTEGER) AS terrain, faces, area2, zero, degenerate, duplicate, boundary, round(100.0 * faces / (SELECT sum(faces) FROM t), 6) AS percent FROM t""")
def a10_surface_totals(spark, d):
    """Totals and quality counters of a surface by terrain."""
    t = _flagged(spark, d).groupBy("terrain").agg(F.count("*").alias("faces"), F.sum("area2").alias("area2"), *[F.count_if(n).alias(n) for n in ("zero", "degenerate", "duplicate", "boundary")])
    # 32 terrains at most
    return t.withColumn("percent", F.round(100.0 * F.col("faces") / F.sum("faces").over(Window.partitionBy()), 6))


@query(FACES + """, g AS (SELECT face, ((z1 - z0) * (h2 - h0) - (h1 - h0) * (z2 - z0)) AS nx, ((h1 - h0) * (x2 - x0) - (x1 - x0) * (h2 - h0)) AS nz, det AS nh, (face % 7) - 3 AS vx, (face % 5) - 2 AS vz, 3 - face % 4 AS vh FROM faces),
c AS (SELECT CASE WHEN nx = 0 AND nz = 0 AND nh = 0 THEN 'degenerate_face' WHEN vx = 0 AND vz = 0 AND vh = 0 THEN 'zero_normal' ELSE CASE sign(nx * vx + nz * vz - nh * vh) WHEN 1 THEN 'along' WHEN 0 THEN 'across' ELSE 'against' END END AS alignment FROM g) SELECT alignment, count(*) AS faces FROM c GROUP BY alignment""")
def a9_normal_alignment(spark, d):
    """Given normals against those of the faces' corners: along, across, against, or undefined."""
    e = lambda a, i: F.col(f"{a}{i}") - F.col(f"{a}0")
    nx, nz, nh = e("z", 1) * e("h", 2) - e("h", 1) * e("z", 2), e("h", 1) * e("x", 2) - e("x", 1) * e("h", 2), tin.determinant()
    f = F.col("face")
    rows = faces(spark, d).select(nx.alias("nx"), nz.alias("nz"), nh.alias("nh"), (f % 7 - 3).alias("vx"), (f % 5 - 2).alias("vz"), (3 - f % 4).alias("vh"))
    side = F.expr("nx * vx + nz * vz - nh * vh")
    kind = F.when(F.expr("nx = 0 AND nz = 0 AND nh = 0"), "degenerate_face").when(F.expr("vx = 0 AND vz = 0 AND vh = 0"), "zero_normal").when(side > 0, "along").when(side == 0, "across").otherwise("against")
    return rows.groupBy(kind.alias("alignment")).agg(F.count("*").alias("faces"))


@query(EDGES + """, m AS (SELECT members, count(*) AS groups FROM (SELECT count(*) AS members FROM kk GROUP BY ck) GROUP BY members) SELECT members, groups FROM m""")
def a11_multiplicity_histogram(spark, d):
    """How many faces share their corners, and how often."""
    return faces(spark, d).groupBy(tin.corner_key().alias("k")).agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))


_EVENTS = FACES + """, ev AS (SELECT o_orderkey AS event, o_custkey % 5 AS class, unnest([2 * (o_custkey % 300), 2 * (o_orderkey % 300) + 1, 2 * (o_custkey % 300), 4000000000 + o_orderkey]) AS trigger FROM orders)"""


def _events(spark, d):
    """Events with lists of triggers: faces by id, some twice, some missing."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(o.alias("event"), (c % 5).alias("class"), F.array(2 * (c % 300), 2 * (o % 300) + 1, 2 * (c % 300), o + 4000000000).alias("triggers"))


@query(_EVENTS + """, own AS (SELECT DISTINCT event, class, trigger FROM ev), j AS (SELECT own.*, f.face, abs(f.det) AS area2 FROM own LEFT JOIN faces f ON f.face = trigger)
SELECT event, class, count(face) AS faces, CAST(coalesce(sum(area2), 0) AS BIGINT) AS area2, count(*) - count(face) AS missing FROM j GROUP BY event, class""")
def j1_trigger_faces(spark, d):
    """Faces of the triggers of events, each once for an event, and triggers without a face."""
    f = tin.metrics(faces(spark, d)).select(F.col("face"), "area2")
    own = _events(spark, d).select("event", "class", F.explode(F.array_distinct("triggers")).alias("trigger"))
    j = own.join(f, F.col("trigger") == F.col("face"), "left")
    return j.groupBy("event", "class").agg(F.count("face").alias("faces"), F.coalesce(F.sum("area2"), F.lit(0)).alias("area2"), (F.count("*") - F.count("face")).alias("missing"))


@query(_EVENTS + """, j AS (SELECT DISTINCT class, f.face, region, terrain, abs(det) AS area2 FROM ev JOIN faces f ON f.face = trigger WHERE class IN (1, 3) AND terrain < 16)
SELECT coalesce(region, -1) AS region, coalesce(terrain, -1) AS terrain, count(*) AS faces, CAST(sum(area2) AS BIGINT) AS area2 FROM (SELECT DISTINCT face, region, terrain, area2 FROM j) GROUP BY GROUPING SETS ((region), (terrain), ())""")
def p10_event_regions(spark, d):
    """Faces of events of two classes on part of the terrains, by region and by terrain, each face once."""
    f = tin.metrics(faces(spark, d)).where("terrain < 16").select("face", "region", "terrain", "area2")
    own = _events(spark, d).where("class IN (1, 3)").select(F.explode("triggers").alias("face")).distinct()
    rows = f.join(own, "face", "left_semi")
    return rows.groupingSets([["region"], ["terrain"], []], "region", "terrain").agg(F.count("*").alias("faces"), F.sum("area2").alias("area2")).fillna(-1, ["region", "terrain"])


@query(FACES + """, o AS (SELECT face, 0 AS off FROM faces UNION ALL SELECT face, -10000 FROM faces UNION ALL SELECT face, -5000 FROM faces UNION ALL SELECT face, 5000 FROM faces UNION ALL SELECT face, 10000 FROM faces)
SELECT off, count(*) AS faces, CAST(min(least(x0, x1, x2) + off) AS BIGINT) AS low, CAST(max(greatest(x0, x1, x2) + off) AS BIGINT) AS high FROM o JOIN faces USING (face) WHERE least(x0, x1, x2) + off <= 7300 AND greatest(x0, x1, x2) + off >= -2650 GROUP BY off""")
def j9_replicas(spark, d):
    """Copies of a periodic surface that reach into a stretch of places, with the offset of each."""
    own = tin.metrics(faces(spark, d)).select("face", "minx", "maxx", F.explode(F.array(*[F.lit(k * WIDTH) for k in range(-2, 3)])).alias("off"))
    own = own.where(F.expr("minx + off <= 7300 AND maxx + off >= -2650"))
    return own.groupBy("off").agg(F.count("*").alias("faces"), F.min(F.expr("minx + off")).alias("low"), F.max(F.expr("maxx + off")).alias("high"))


@query(EDGES + """, g AS (SELECT DISTINCT least(face, other) AS a, greatest(face, other) AS b FROM edges WHERE incidence = 2 AND faces = 2 AND NOT amb), k AS (SELECT DISTINCT least(2 * p_partkey, 2 * p_partkey + 1 - 98 * (p_partkey % 2)) AS a, greatest(2 * p_partkey, 2 * p_partkey + 1 - 98 * (p_partkey % 2)) AS b FROM part)
SELECT CASE WHEN g.a IS NULL THEN 'routing_only' WHEN k.a IS NULL THEN 'geometry_only' ELSE 'shared' END AS kind, count(*) AS pairs FROM g FULL JOIN k ON g.a = k.a AND g.b = k.b GROUP BY 1""")
def j12_adjacency_against_arcs(spark, d):
    """Neighbours by geometry against neighbours by a given graph: shared, geometry only, routing only."""
    e = topology.edges(faces(spark, d), WIDTH).where(topology.unique_raw())
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    g = e.select(*pair(F.col("face"), F.col("other"))).distinct().withColumn("g", F.lit(True))
    k = F.col("p_partkey")
    arcs = table(spark, d, "part").select(*pair(2 * k, 2 * k + 1 - 98 * (k % 2))).distinct().withColumn("k", F.lit(True))
    kind = F.when(F.col("g").isNull(), "routing_only").when(F.col("k").isNull(), "geometry_only").otherwise("shared")
    return g.join(arcs, ["a", "b"], "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("pairs"))


@query(EDGES + """, s AS (SELECT lo, hi, side, incidence, amb, face FROM edges WHERE side IS NOT NULL), p AS (SELECT w.lo, w.hi, w.face AS west, e.face AS east, w.incidence = 1 AND e.incidence = 1 AND NOT w.amb AND NOT e.amb AND w.face <> e.face AS good FROM s w JOIN s e ON w.lo = e.lo AND w.hi = e.hi AND w.side = 'west' AND e.side = 'east')
SELECT lo[1] AS z, west, east, good FROM p""")
def j11_seam_pairs(spark, d):
    """Sides of the seam that fit together, and whether the pair is confirmed."""
    e = topology.edges(topology.on_seam(faces(spark, d), WIDTH), WIDTH).where("side IS NOT NULL AND seam <> 'unmatched'")
    return e.where("side = 'west'").select(F.least("a.z", "b.z").alias("z"), F.col("face").alias("west"), F.col("partner").alias("east"), (F.col("seam") == "paired").alias("good"))


_SOURCES = """WITH src AS (SELECT p_partkey AS face, p_size % 9 AS sec, p_partkey % 16 AS mesh FROM part),
ent AS (SELECT c_custkey AS entrance, c_custkey % 400 AS face, c_nationkey AS place FROM customer), evn AS (SELECT o_orderkey AS event, o_custkey % 700 AS face, o_orderpriority AS sha FROM orders),
e1 AS (SELECT face, count(*) AS n, min(entrance) AS first FROM ent GROUP BY face), e2 AS (SELECT face, count(*) AS n, min(sha) <> '1-URGENT' OR max(sha) <> '5-LOW' AS odd FROM evn GROUP BY face)"""


@query(_SOURCES + """ SELECT src.face, CASE WHEN e1.n IS NULL THEN 'no_direct_relation' ELSE 'linked' END AS entrances, coalesce(e1.n, 0) AS n_entrances, coalesce(first, -1) AS first_entrance,
  CASE WHEN sec = 8 THEN 'unavailable' WHEN e2.n IS NULL THEN 'no_direct_relation' WHEN odd THEN 'source_mismatch' ELSE 'linked' END AS events, CASE WHEN mesh = 0 THEN 'not_applicable' WHEN e1.n IS NULL THEN 'no_direct_relation' ELSE 'linked' END AS places FROM src LEFT JOIN e1 USING (face) LEFT JOIN e2 USING (face)""")
def j13_source_evidence(spark, d):
    """Source faces with the status of each dimension of evidence; a missing one is a status, not an error."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("face"), (F.col("p_size") % 9).alias("sec"), (F.col("p_partkey") % 16).alias("mesh"))
    e1 = table(spark, d, "customer").groupBy((F.col("c_custkey") % 400).alias("face")).agg(F.count("*").alias("n1"), F.min("c_custkey").alias("first"))
    e2 = table(spark, d, "orders").groupBy((F.col("o_custkey") % 700).alias("face")).agg(F.count("*").alias("n2"), F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi"))
    j = p.join(e1, "face", "left").join(e2, "face", "left")
    status = lambda *rules: _first(rules, "linked")
    entrances = status((F.expr("n1 IS NULL"), "no_direct_relation"))
    events = status((F.expr("sec = 8"), "unavailable"), (F.expr("n2 IS NULL"), "no_direct_relation"), (F.expr("lo <> '1-URGENT' OR hi <> '5-LOW'"), "source_mismatch"))
    places = status((F.expr("mesh = 0"), "not_applicable"), (F.expr("n1 IS NULL"), "no_direct_relation"))
    return j.select("face", entrances.alias("entrances"), F.coalesce("n1", F.lit(0)).alias("n_entrances"), F.coalesce("first", F.lit(-1)).alias("first_entrance"), events.alias("events"), places.alias("places"))


def _first(rules, otherwise):
    """The word of the first rule that holds."""
    out = None
    for condition, word in rules:
        out = F.when(condition, word) if out is None else out.when(condition, word)
    return out.otherwise(otherwise)


_REASONS = (("c_acctbal < 0", "negative_balance"), ("n_nationkey IS NULL", "missing_place"), ("c_custkey % 13 = 0", "other_source"), ("c_mktsegment = 'MACHINERY' AND n_regionkey <> 1", "wrong_region"), ("suppliers IS NULL OR suppliers = 0", "no_field"), ("c_custkey % 5 = 4 AND suppliers > 1", "ambiguous_field"))


@query(f"""WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY k), j AS (SELECT c.*, n.*, suppliers FROM customer c LEFT JOIN nation n ON n_nationkey = c_nationkey AND c_custkey % 17 <> 0 LEFT JOIN s ON s.k = c_nationkey)
SELECT c_custkey AS entrance, CASE {" ".join(f"WHEN {c} THEN '{w}'" for c, w in _REASONS)} ELSE 'verified_direct' END AS status FROM j""")
def j17_entrance_reasons(spark, d):
    """Entrances checked across tables: the first of the ordered reasons against each, or verified."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = c.join(n, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_custkey") % 17 != 0), "left").join(s, F.col("k") == F.col("c_nationkey"), "left")
    return j.select(F.col("c_custkey").alias("entrance"), _first([(F.expr(c), w) for c, w in _REASONS], "verified_direct").alias("status"))


@query("""WITH e AS (SELECT c_custkey AS entity, c_mktsegment AS kind, c_nationkey AS place FROM customer), p AS (SELECT s_nationkey AS place, min(s_suppkey) AS entrance, count(*) AS n FROM supplier GROUP BY place)
SELECT entity, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'entrance_level' WHEN kind = 'BUILDING' THEN 'parent_place' ELSE 'ambiguous' END AS precision, CASE WHEN n = 1 OR n > 1 AND kind = 'BUILDING' THEN entrance ELSE -1 END AS entrance FROM e LEFT JOIN p USING (place)""")
def j15_entity_bindings(spark, d):
    """Entities bound to the primary entrance of their place, with how precise that is."""
    p = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("place")).agg(F.min("s_suppkey").alias("entrance"), F.count("*").alias("n"))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("place"))
    precision = _first([(F.expr("n IS NULL"), "unresolved"), (F.expr("n = 1"), "entrance_level"), (F.expr("kind = 'BUILDING'"), "parent_place")], "ambiguous")
    return e.join(p, "place", "left").select("entity", precision.alias("precision"), F.expr("CASE WHEN n = 1 OR n > 1 AND kind = 'BUILDING' THEN entrance ELSE -1 END").alias("entrance"))


@query("""WITH t AS (SELECT event_id, event_id % 40 AS grp, CAST(user_id % 8 AS INTEGER) AS state FROM events WHERE event_type = 'click'), g AS (SELECT p_partkey AS tile, p_partkey % 40 AS grp, p_size % 256 AS mask FROM part)
SELECT event_id, count(tile) AS tiles, coalesce(min(tile), -1) AS first FROM t LEFT JOIN g ON t.grp = g.grp AND (mask >> state) & 1 = 1 GROUP BY event_id""")
def j23_mask_tiles(spark, d):
    """Triggers (group, state bit) with the tiles of their group whose mask has the bit."""
    t = table(spark, d, "events").where("event_type = 'click'").select("event_id", (F.col("event_id") % 40).alias("grp"), (F.col("user_id") % 8).cast("int").alias("state"))
    # a row for each bit that a mask has: the join is on keys alone, counted before it
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.expr("p_size % 256").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
    g = table(spark, d, "part").select(F.col("p_partkey").alias("tile"), (F.col("p_partkey") % 40).alias("grp"), F.explode(bits).alias("state")).groupBy("grp", "state").agg(F.count("*").alias("tiles"), F.min("tile").alias("first"))
    return t.join(g, ["grp", "state"], "left").select("event_id", F.coalesce("tiles", F.lit(0)).alias("tiles"), F.coalesce("first", F.lit(-1)).alias("first"))


_OWNED = "WITH o AS (SELECT l_orderkey AS r, l_suppkey % 50 AS actor, l_linenumber AS entry FROM lineitem)"


@query(_OWNED + """, u AS (SELECT DISTINCT r, actor, entry FROM o), e AS (SELECT actor, entry, count(DISTINCT r) AS n FROM u GROUP BY ALL), a AS (SELECT actor, count(DISTINCT r) AS n FROM u GROUP BY actor)
SELECT u.r, max(a.n) - 1 AS same_actor, max(e.n) - 1 AS same_entry FROM u JOIN e USING (actor, entry) JOIN a USING (actor) GROUP BY u.r""")
def j24_related_records(spark, d):
    """Most other records that share an actor, and an entry of an actor, with each record; counted, never paired."""
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("r"), (F.col("l_suppkey") % 50).alias("actor"), F.col("l_linenumber").alias("entry")).distinct()
    e = o.groupBy("actor", "entry").agg(F.count_distinct("r").alias("same_entry"))
    a = o.groupBy("actor").agg(F.count_distinct("r").alias("same_actor"))
    return o.join(e, ["actor", "entry"]).join(a, "actor").groupBy("r").agg((F.max("same_actor") - 1).alias("same_actor"), (F.max("same_entry") - 1).alias("same_entry"))


@query("""WITH a AS (SELECT c_nationkey AS k, md5(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment)) AS sha FROM customer GROUP BY k), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN md5('other') ELSE md5('AUTOMOBILE,BUILDING,FURNITURE,HOUSEHOLD,MACHINERY') END AS sha FROM nation)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing_left' WHEN b.k IS NULL THEN 'missing_right' WHEN a.sha = b.sha THEN 'agrees' ELSE 'mismatch' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def j35_source_agreement(spark, d):
    """Two assets' maps of source identities compared key by key."""
    names = F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",")
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.md5(names.cast("binary")).alias("sha"))
    n = F.col("n_nationkey")
    b = table(spark, d, "nation").select(n.alias("k"), F.md5(F.when(n % 3 == 0, "other").otherwise("AUTOMOBILE,BUILDING,FURNITURE,HOUSEHOLD,MACHINERY").cast("binary")).alias("other"))
    status = _first([(F.expr("sha IS NULL"), "missing_left"), (F.expr("other IS NULL"), "missing_right"), (F.expr("sha = other"), "agrees")], "mismatch")
    return a.join(b, "k", "full").select("k", status.alias("status"))


@query("""WITH r AS (SELECT o_orderpriority AS status, o_custkey % 3 AS kind, o_orderkey % 11 = 0 AS literal FROM orders) SELECT status, count(*) AS scenes, count(*) FILTER (kind = 0) AS grants, count(*) FILTER (kind = 0 AND literal AND status <> '5-LOW') AS static_grants, count(*) FILTER (kind = 1) AS battles, round(100.0 * count(*) FILTER (literal) / count(*), 6) AS literal_percent FROM r GROUP BY status""")
def a24_coverage_counters(spark, d):
    """Counters of an asset by status; a partial record is never a static grant."""
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("status"), (F.col("o_custkey") % 3).alias("kind"), (F.col("o_orderkey") % 11 == 0).alias("literal"))
    return r.groupBy("status").agg(F.count("*").alias("scenes"), F.count_if(F.expr("kind = 0")).alias("grants"), F.count_if(F.expr("kind = 0 AND literal AND status <> '5-LOW'")).alias("static_grants"), F.count_if(F.expr("kind = 1")).alias("battles"), F.round(100.0 * F.count_if("literal") / F.count("*"), 6).alias("literal_percent"))


@query("""SELECT event_type AS op, count(*) AS sites, count(DISTINCT user_id) AS owners, min(event_id) AS first FROM events GROUP BY event_type""")
def a25_opcode_inventory(spark, d):
    """Sites and owners of every opcode, with the first site."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("sites"), F.count_distinct("user_id").alias("owners"), F.min("event_id").alias("first"))


@query("""SELECT l_linestatus AS layer, count(*) AS tiles, count(*) FILTER (l_discount > 0.05) AS conditional, count(DISTINCT l_linenumber) AS groups, min(l_partkey) AS lowest FROM lineitem WHERE l_returnflag <> 'A' OR l_linenumber = 1 GROUP BY l_linestatus""")
def a28_layer_statistics(spark, d):
    """Tiles of the selected states by layer: how many are conditional, groups, and the lowest."""
    li = table(spark, d, "lineitem").where("l_returnflag <> 'A' OR l_linenumber = 1")
    return li.groupBy(F.col("l_linestatus").alias("layer")).agg(F.count("*").alias("tiles"), F.count_if(F.expr("l_discount > 0.05")).alias("conditional"), F.count_distinct("l_linenumber").alias("groups"), F.min("l_partkey").alias("lowest"))


_ENTITIES = """WITH e AS (SELECT s_suppkey AS id, 'Sup ' || s_suppkey || '_plier' AS local, s_name AS canonical, n_name AS alias, CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'minor' ELSE 'major' END AS spoiler, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey),
n AS (SELECT *, trim(regexp_replace(lower(local), '[↔<>\\s_-]+', ' ', 'g')) AS l, trim(regexp_replace(lower(canonical), '[↔<>\\s_-]+', ' ', 'g')) AS c, lower(alias) AS a FROM e WHERE spoiler <> 'major')"""


@query(_ENTITIES + """, q AS (SELECT unnest(['sup 4 plier', 'sup 1', 'plier', 'supplier#000000007', 'china', 'an', 'zzzz', 'suq 4 plier', '']) AS q),
r AS (SELECT q, id, l, CASE WHEN q = '' THEN 0 WHEN l = q THEN 0 WHEN c = q THEN 1 WHEN starts_with(l, q) THEN 2 WHEN contains(l, q) THEN 4 WHEN contains(a, q) THEN 5 WHEN length(q) >= 4 AND (levenshtein(l, q) <= 1 OR levenshtein(a, q) <= 1) THEN 9 END AS tier FROM n, q)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY tier, l, id) AS INTEGER) AS rank, id, CAST(tier AS INTEGER) AS tier FROM r WHERE tier IS NOT NULL""")
def o3_ranked_search(spark, d):
    """Entities that a reader may see, ranked by tiers for each search text, the nearest names last (also F2)."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("alias"))
    e = table(spark, d, "supplier").join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"))  # 25 nations
    e = e.where(F.col("s_suppkey") % 3 != 2)
    named = lambda c: search.collapsed(c)
    e = e.select(F.col("s_suppkey").alias("id"), named(F.concat(F.lit("Sup "), F.col("s_suppkey").cast("string"), F.lit("_plier"))).alias("l"), named(F.col("s_name")).alias("c"), named(F.col("alias")).alias("a"))
    texts = ["sup 4 plier", "sup 1", "plier", "supplier#000000007", "china", "an", "zzzz", "suq 4 plier", ""]
    q = F.explode(F.array(*[F.lit(t) for t in texts]))
    near = lambda name: (F.length("q") >= 4) & (F.levenshtein(name, F.col("q"), 1) >= 0)
    rows = e.select("id", "l", "c", "a", q.alias("q"))
    tier = F.when(F.col("q") == "", 0).when(F.col("l") == F.col("q"), 0).when(F.col("c") == F.col("q"), 1).when(F.col("l").startswith(F.col("q")), 2).when(F.contains("l", "q"), 4).when(F.contains("a", "q"), 5).when(near(F.col("l")) | near(F.col("a")), 9)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("tier", "l", "id"))
    return rows.withColumn("tier", tier).where("tier IS NOT NULL").select("q", rank.alias("rank"), "id", "tier")


@query("""WITH t AS (SELECT p_partkey AS id, lower(p_type || ' ' || p_name) AS text FROM part) SELECT q, count(*) AS tools, min(id) AS first FROM t, (SELECT unnest(['brass economy', 'steel', 'a e o', 'nothing here']) AS q) WHERE len(list_filter(string_split(q, ' '), lambda w: NOT contains(text, w))) = 0 GROUP BY q""")
def o5_all_terms(spark, d):
    """Tools whose text holds every term of a search."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("text"))
    rows = t.select("id", "text", F.explode(F.array(*[F.lit(x) for x in ("brass economy", "steel", "a e o", "nothing here")])).alias("q"))
    return rows.where(F.forall(F.split("q", " "), lambda w: F.contains(F.col("text"), w))).groupBy("q").agg(F.count("*").alias("tools"), F.min("id").alias("first"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey AS owner, CAST(n AS INTEGER) AS n, l_orderkey, l_linenumber, total FROM r WHERE n BETWEEN 11 AND 20""")
def o6_pages(spark, d):
    """The second page of ten rows of each owner in order, with the count of all (also O7, O8, O9: capped lists beside whole counts)."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    li = table(spark, d, "lineitem")
    total = li.groupBy("l_suppkey").agg(F.count("*").alias("total"))
    page = li.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("n")).where("n <= 20").where("n >= 11")
    return page.join(total, "l_suppkey").select(F.col("l_suppkey").alias("owner"), "n", "l_orderkey", "l_linenumber", "total")


@query("""WITH o AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), u AS (SELECT DISTINCT user_id, event_type, k FROM o) SELECT user_id, count(*) AS observations FROM u GROUP BY user_id""")
def u9_distinct_observations(spark, d):
    """Observations of each user, equal ones once, by their canonical form."""
    o = table(spark, d, "events").select("user_id", F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("form"))
    return o.dropDuplicates(["user_id", "form"]).groupBy("user_id").agg(F.count("*").alias("observations"))


@query(_OTHER + """, sd AS (SELECT o, unnest([[(x0, z0, h0), (x1, z1, h1)], [(x1, z1, h1), (x2, z2, h2)], [(x2, z2, h2), (x0, z0, h0)]]) AS e FROM u), k AS (SELECT o, list_sort(e) AS e, count(*) AS n FROM sd GROUP BY ALL HAVING count(*) = 1),
a AS (SELECT e FROM k WHERE o = 0), b AS (SELECT e FROM k WHERE o = 1) SELECT count(*) FILTER (a.e IS NOT NULL AND b.e IS NOT NULL) AS shared, count(*) FILTER (b.e IS NULL) AS base_only, count(*) FILTER (a.e IS NULL) AS other_only FROM a FULL JOIN b ON a.e = b.e""")
def u3_perimeters(spark, d):
    """Open sides of a surface and of its other version: shared, and of one only."""
    def rim(f, name):
        occ = topology.occurrences(f.select("face", *_NAMES)).groupBy("a", "b").agg(F.count("*").alias("n"))
        return occ.where("n = 1").select("a", "b", F.lit(True).alias(name))

    both = rim(faces(spark, d), "base").join(rim(_other(spark, d), "other"), ["a", "b"], "full")
    return both.agg(F.count_if(F.expr("base AND other")).alias("shared"), F.count_if(F.expr("other IS NULL")).alias("base_only"), F.count_if(F.expr("base IS NULL")).alias("other_only"))


@query(FACES + """, g AS (SELECT face, region % 5 AS grp FROM faces), s AS (SELECT unnest(range(5)) AS state) SELECT CAST(state AS INTEGER) AS state, count(*) AS visible, count(*) FILTER (face >= 1000000000) AS alternatives FROM s JOIN g ON (grp = 0 OR (face < 1000000000 AND grp > state) OR (face >= 1000000000 AND grp <= state)) GROUP BY state""")
def p18_visible_variants(spark, d):
    """Faces that show in each of five states: alternatives take the place of base faces, group after group."""
    f = faces(spark, d).select((F.col("face") >= 1_000_000_000).alias("alternative"), (F.col("region") % 5).alias("grp")).groupBy("alternative", "grp").agg(F.count("*").alias("n"))
    s = f.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("state")).where("grp = 0 OR NOT alternative AND grp > state OR alternative AND grp <= state")
    return s.groupBy("state").agg(F.sum("n").alias("visible"), F.sum(F.when(F.col("alternative"), F.col("n")).otherwise(0)).alias("alternatives"))


@query("""WITH r AS (SELECT n_nationkey AS id, (n_nationkey % 5) * 1000 AS x0, (n_nationkey % 5) * 1000 + 1000 - 300 * (n_nationkey % 2) AS x1, (n_nationkey // 5) * 900 AS z0, (n_nationkey // 5) * 900 + 900 AS z1 FROM nation),
p AS (SELECT c_custkey AS k, (c_custkey * 250) % 5500 AS x, (c_custkey * 150) % 5000 AS z FROM customer), c AS (SELECT k, bool_or(x0 < x AND z0 < z) AS ll, bool_or(x1 > x AND z0 < z) AS rl, bool_or(x0 < x AND z1 > z) AS lu, bool_or(x1 > x AND z1 > z) AS ru FROM p JOIN r ON x BETWEEN x0 AND x1 AND z BETWEEN z0 AND z1 GROUP BY k)
SELECT p.k, CASE WHEN c.k IS NULL THEN 'outside' WHEN ll AND rl AND lu AND ru THEN 'inside' ELSE 'boundary' END AS coverage FROM p LEFT JOIN c USING (k)""")
def p19_coverage(spark, d):
    """Points inside, on the boundary of or outside a union of rectangles, told by the four quadrants around each."""
    n = F.col("n_nationkey")
    row = F.floor(n / 5)
    r = table(spark, d, "nation").select((n % 5 * 1000).alias("x0"), (n % 5 * 1000 + 1000 - 300 * (n % 2)).alias("x1"), (row * 900).alias("z0"), (row * 900 + 900).alias("z1"))
    c = F.col("c_custkey")
    p = table(spark, d, "customer").select(c.alias("k"), ((c * 250) % 5500).alias("x"), ((c * 150) % 5000).alias("z"))
    # at most 25 rectangles
    met = p.join(F.broadcast(r), F.expr("x BETWEEN x0 AND x1 AND z BETWEEN z0 AND z1"), "left")
    quadrants = [F.coalesce(F.max(F.expr(q)), F.lit(False)) for q in ("x0 < x AND z0 < z", "x1 > x AND z0 < z", "x0 < x AND z1 > z", "x1 > x AND z1 > z")]
    every = quadrants[0] & quadrants[1] & quadrants[2] & quadrants[3]
    return met.groupBy("k").agg(F.when(F.count("x0") == 0, "outside").when(every, "inside").otherwise("boundary").alias("coverage"))


@query("""WITH a AS (SELECT s_suppkey AS id, s_suppkey % 40 AS target, CASE s_suppkey % 5 WHEN 0 THEN 'entrance_level' WHEN 1 THEN 'verified_anchor' WHEN 2 THEN 'field_identity' WHEN 3 THEN 'user_created' ELSE 'exact_source' END AS precision, s_nationkey % 2 = 0 AS own FROM supplier),
g AS (SELECT * FROM a WHERE precision IN ('entrance_level', 'verified_anchor', 'exact_source') OR precision = 'user_created' AND own) SELECT target, min(id) AS anchor, arg_min(precision, id) AS precision FROM g GROUP BY target""")
def p20_anchors(spark, d):
    """Anchors that are precise enough to be found nearby, the first for each target."""
    s = F.col("s_suppkey")
    precision = F.element_at(F.array(*[F.lit(x) for x in ("entrance_level", "verified_anchor", "field_identity", "user_created", "exact_source")]), (s % 5 + 1).cast("int"))
    a = table(spark, d, "supplier").select(s.alias("id"), (s % 40).alias("target"), precision.alias("precision"), (F.col("s_nationkey") % 2 == 0).alias("own"))
    good = a.where("precision IN ('entrance_level', 'verified_anchor', 'exact_source') OR precision = 'user_created' AND own")
    return good.groupBy("target").agg(F.min("id").alias("anchor"), F.min_by("precision", "id").alias("precision"))


@query("""WITH s AS (SELECT c_custkey AS station, c_nationkey AS place, c_mktsegment AS kind, c_acctbal FROM customer), e AS (SELECT s_nationkey AS place, min(s_suppkey) AS node, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY place)
SELECT station, CASE WHEN kind = 'FURNITURE' THEN 'unsupported_kind' WHEN c_acctbal < 0 THEN 'other_map' WHEN n IS NULL THEN 'no_entrance' ELSE 'ok' END AS reason, CASE WHEN kind <> 'FURNITURE' AND c_acctbal >= 0 THEN coalesce(n, 0) ELSE 0 END AS endpoints FROM s LEFT JOIN e USING (place)""")
def j38_station_endpoints(spark, d):
    """Stations with the number of their endpoints, or the first reason why there are none."""
    e = table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("place")).agg(F.count("*").alias("n"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("station"), F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("kind"), "c_acctbal").join(e, "place", "left")
    reason = _first([(F.expr("kind = 'FURNITURE'"), "unsupported_kind"), (F.expr("c_acctbal < 0"), "other_map"), (F.expr("n IS NULL"), "no_entrance")], "ok")
    return s.select("station", reason.alias("reason"), F.when(reason == "ok", F.col("n")).otherwise(0).alias("endpoints"))


@query("""WITH r AS (SELECT s_suppkey AS off, s_suppkey % 30 AS scene, s_suppkey % 7 AS rating, s_suppkey % 4 <> 0 AS valid FROM supplier), m AS (SELECT scene, min(off) AS off, arg_min(rating, off) AS rating FROM r WHERE valid GROUP BY scene)
SELECT p_partkey AS k, coalesce(rating, -1) AS rating, coalesce(off, -1) AS off FROM part LEFT JOIN m ON scene = p_partkey % 60""")
def j5_first_rating(spark, d):
    """Scene to rating: the first valid row of a table, -1 without one."""
    s = F.col("s_suppkey")
    r = table(spark, d, "supplier").where(s % 4 != 0).groupBy((s % 30).alias("scene")).agg(F.min(s).alias("off"), F.min_by(s % 7, s).alias("rating"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 60).alias("scene"))
    return p.join(r, "scene", "left").select("k", F.coalesce("rating", F.lit(-1)).alias("rating"), F.coalesce("off", F.lit(-1)).alias("off"))
