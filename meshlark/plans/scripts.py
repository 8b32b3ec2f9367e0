"""Queries over programs, scenes, indexes with budgets, membership in components, and results that are written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.functions import binary as b
from meshlark.operators import bytecode, topology
from meshlark.plans.catalog import _PARTS, EDGES, _parts, _recursive, query
from meshlark.sources import sinks
from meshlark.sources.tables import WIDTH, faces, table


def _shared(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/meshlark-out-{uuid.uuid4().hex}"


_PROGRAMS = """WITH RECURSIVE w AS (SELECT p_partkey AS k, list_transform(range(16), lambda j: (p_partkey * 37 + j * 101) % 872) AS w FROM part), z AS (SELECT k, w, list_transform(w, lambda o: CASE WHEN (o > 256 AND o < 512) OR o IN (512, 513) THEN 2 ELSE 1 END) AS s FROM w),
d(k, pc) AS (SELECT k, 0 FROM z UNION ALL SELECT d.k, pc + s[pc + 1] FROM d JOIN z USING (k) WHERE w[pc + 1] <= 853 AND pc + s[pc + 1] < 16),
i AS (SELECT d.k, pc, w[pc + 1] AS op, s[pc + 1] AS size, CASE WHEN s[pc + 1] = 2 AND pc + 2 <= 16 THEN w[pc + 2] ELSE -1 END AS arg, w[pc + 1] > 853 OR pc + s[pc + 1] > 16 AS bad FROM d JOIN z USING (k)), g AS (SELECT k, bool_or(bad) AS bad FROM i GROUP BY k)"""


def _programs(spark, d):
    k = F.col("p_partkey")
    words = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: ((k * 37 + j * 101) % 872).cast("int"))
    return bytecode.instructions(table(spark, d, "part").select(k.alias("k"), words.alias("words")), "k", "words")


@query(_PROGRAMS + """ SELECT k, 'ok' AS status, CAST(pc AS INTEGER) AS pc, CAST(op AS INTEGER) AS op, CAST(arg AS INTEGER) AS arg FROM i JOIN g USING (k) WHERE NOT g.bad UNION ALL SELECT k, 'invalid', -1, -1, -1 FROM g WHERE bad""")
def s8_instructions(spark, d):
    """Programs of words taken apart; an unknown opcode or a cut-off operand makes the whole program one error row."""
    return _programs(spark, d).select("k", "status", "pc", "op", "arg")


@query(_PROGRAMS + """, o AS (SELECT op, count(*) AS sites, count(DISTINCT i.k) AS programs FROM i JOIN g USING (k) WHERE NOT g.bad GROUP BY op) SELECT CAST(op AS INTEGER) AS op, CASE WHEN op BETWEEN 516 AND 767 THEN 'call' WHEN op = 515 THEN 'return' WHEN op IN (512, 513) THEN 'jump' WHEN op > 256 AND op < 512 THEN 'push' ELSE 'plain' END AS kind, sites, programs FROM o""")
def x3_opcode_kinds(spark, d):
    """Opcodes by kind with their sites and programs."""
    own = _programs(spark, d).where("status = 'ok'").groupBy("op").agg(F.count("*").alias("sites"), F.count_distinct("k").alias("programs"))
    return own.select("op", bytecode.kind(F.col("op")).alias("kind"), "sites", "programs")


@query("""WITH s AS (SELECT l_orderkey AS script, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS selected, bool_or(l_linestatus = 'F') AS partial, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey),
g AS (SELECT l_orderkey AS script, l_linenumber AS at, l_linenumber - dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT script, count(DISTINCT run) AS ranges FROM g GROUP BY script)
SELECT script, CASE WHEN n > 6 THEN 'limited' WHEN selected = 0 THEN 'empty' WHEN partial THEN 'partial' ELSE 'indexed' END AS status, CASE WHEN n > 6 THEN 0 ELSE selected END AS records, CASE WHEN n > 6 THEN 0 ELSE coalesce(ranges, 0) END AS ranges FROM s LEFT JOIN r USING (script)""")
def x7_script_index(spark, d):
    """Scripts with their selected records, the ranges these cover, and how whole that is; beyond the budget nothing is kept."""
    li = table(spark, d, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("script")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("selected"), F.max(F.col("l_linestatus") == "F").alias("partial"))
    g = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("script"), (F.col("l_linenumber") - F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).alias("run"))
    j = s.join(g.groupBy("script").agg(F.count_distinct("run").alias("ranges")), "script", "left")
    status = F.when(F.col("n") > 6, "limited").when(F.col("selected") == 0, "empty").when(F.col("partial"), "partial").otherwise("indexed")
    kept = lambda c: F.when(F.col("n") > 6, 0).otherwise(c)
    return j.select("script", status.alias("status"), kept(F.col("selected")).alias("records"), kept(F.coalesce("ranges", F.lit(0))).alias("ranges"))


@query("""WITH s AS (SELECT l_suppkey % 12 AS value, l_orderkey * 10 + l_linenumber AS site, l_quantity > 25 AS literal FROM lineitem) SELECT value, count(*) FILTER (literal) AS sites, count(*) FILTER (NOT literal) AS unresolved, min(site) FILTER (literal) AS first, max(site) FILTER (literal) AS last FROM s GROUP BY value""")
def x16_progress_sites(spark, d):
    """Sites that set each progress value: those with a literal, and how many could not be resolved."""
    s = table(spark, d, "lineitem").select((F.col("l_suppkey") % 12).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), (F.col("l_quantity") > 25).alias("literal"))
    known = F.when(F.col("literal"), F.col("site"))
    return s.groupBy("value").agg(F.count_if("literal").alias("sites"), F.count_if(~F.col("literal")).alias("unresolved"), F.min(known).alias("first"), F.max(known).alias("last"))


@query(_recursive(EDGES) + _PARTS.format(seam="") + """, l AS (SELECT c_custkey AS place, unnest([2 * (c_custkey % 200), 2 * (c_custkey % 200) + 1, 2 * ((c_custkey * 7) % 200)]) AS face FROM customer)
SELECT place, count(DISTINCT label) AS components, min(label) AS first, count(DISTINCT region) AS regions FROM l JOIN part_of USING (face) JOIN faces USING (face) GROUP BY place""")
def j14_component_membership(spark, d):
    """Components and regions that the triggers of each place lie in."""
    f, label = _parts(spark, d, False)
    c = F.col("c_custkey")
    l = table(spark, d, "customer").select(c.alias("place"), F.explode(F.array(2 * (c % 200), 2 * (c % 200) + 1, 2 * ((c * 7) % 200))).alias("face")).distinct()
    j = l.join(label.withColumnRenamed("node", "face"), "face").join(f.select("face", "region"), "face")
    return j.groupBy("place").agg(F.count_distinct("label").alias("components"), F.min("label").alias("first"), F.count_distinct("region").alias("regions"))


@query("""WITH t AS (SELECT c_custkey AS entrance, c_custkey % 300 AS face FROM customer), n AS (SELECT p_partkey AS face, p_size AS node FROM part) SELECT node, entrance, CAST(row_number() OVER (PARTITION BY node ORDER BY entrance) AS INTEGER) AS place FROM t JOIN n USING (face)""")
def j2_entrance_nodes(spark, d):
    """Graph nodes of the entrances' triggers, in order of node and entrance."""
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("entrance"), (F.col("c_custkey") % 300).alias("face"))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("face"), F.col("p_size").alias("node"))
    return t.join(n, "face").select("node", "entrance", F.row_number().over(Window.partitionBy("node").orderBy("entrance")).alias("place"))


@query("""WITH f AS (SELECT s_suppkey AS formation, s_nationkey AS scene FROM supplier), u AS (SELECT 'script' AS origin, o_orderkey AS id, o_custkey % 40 AS scene FROM orders UNION ALL SELECT 'event', event_id, user_id % 40 FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'encounter', p_partkey, p_size % 40 FROM part),
c AS (SELECT scene, count(*) AS n, min(formation) AS formation FROM f GROUP BY scene) SELECT origin, CASE WHEN n IS NULL THEN 'unknown' ELSE 'matched' END AS status, count(*) AS links, coalesce(min(formation), -1) AS first FROM u LEFT JOIN c USING (scene) GROUP BY ALL""")
def j20_formation_links(spark, d):
    """Formations of scripts, events and encounters: matched or unknown, by origin."""
    c = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("scene")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("formation"))
    rows = lambda name, t, id_, scene: t.select(F.lit(name).alias("origin"), F.col(id_).cast("long").alias("id"), (F.col(scene) % 40).cast("long").alias("scene"))
    u = rows("script", table(spark, d, "orders"), "o_orderkey", "o_custkey").union(rows("event", table(spark, d, "events").where("event_type = 'purchase'"), "event_id", "user_id")).union(rows("encounter", table(spark, d, "part"), "p_partkey", "p_size"))
    return u.join(c, "scene", "left").groupBy("origin", F.when(F.col("n").isNull(), "unknown").otherwise("matched").alias("status")).agg(F.count("*").alias("links"), F.coalesce(F.min("formation"), F.lit(-1)).alias("first"))


@query("""WITH a AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END AS scene, c_nationkey AS place, c_mktsegment AS kind FROM customer), v AS (SELECT s_nationkey AS place, min(s_suppkey) AS field FROM supplier WHERE s_acctbal > 0 GROUP BY place)
SELECT entity, CASE WHEN scene IS NOT NULL THEN 'authored_scene' WHEN field IS NOT NULL THEN 'verified_entrance' ELSE 'unresolved' END AS source, coalesce(scene, field, -1) AS field FROM a LEFT JOIN v USING (place)""")
def j21_entity_fields(spark, d):
    """Fields of entities: of the authored scene, else of the verified entrance."""
    v = table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("place")).agg(F.min("s_suppkey").alias("field"))
    scene = F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey"))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), scene.alias("scene"), F.col("c_nationkey").alias("place"))
    source = F.when(F.col("scene").isNotNull(), "authored_scene").when(F.col("field").isNotNull(), "verified_entrance").otherwise("unresolved")
    return a.join(v, "place", "left").select("entity", source.alias("source"), F.coalesce(F.col("scene").cast("long"), F.col("field"), F.lit(-1)).alias("field"))


@query("""SELECT r.k, count(p.p_partkey) AS matches FROM (SELECT p_partkey AS k, p_size AS size, p_type AS type, p_brand AS brand FROM part) r LEFT JOIN part p ON p.p_partkey = r.k AND p.p_size = r.size AND p.p_type = r.type AND p.p_brand = CASE WHEN r.k % 5 = 0 THEN 'other' ELSE r.brand END GROUP BY r.k""")
def j22_exact_profiles(spark, d):
    """Reviewed profiles that agree with a record in every attribute; one that doesn't is no match."""
    p = table(spark, d, "part")
    names = ["p_partkey", "p_size", "p_type", "p_brand"]
    reviewed = p.select(F.col("p_partkey").alias("k"), F.struct("p_partkey", "p_size", "p_type", F.when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand")).alias("x"))
    found = p.select(F.struct(*names).alias("x"), F.lit(1).alias("one"))
    return reviewed.join(found, "x", "left").groupBy("k").agg(F.count("one").alias("matches"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS actor, l_orderkey AS line FROM lineitem WHERE l_returnflag = 'N'), o AS (SELECT DISTINCT l_suppkey AS actor, l_orderkey * 10 + l_linenumber AS op FROM lineitem WHERE l_returnflag = 'A'),
n AS (SELECT actor, count(*) AS lines, min(line) AS first FROM l GROUP BY actor) SELECT op, CAST(sum(lines) AS BIGINT) AS lines, min(first) AS first FROM o JOIN n USING (actor) GROUP BY op""")
def j25_line_links(spark, d):
    """Lines that an operation's actor owns, counted for each operation."""
    li = table(spark, d, "lineitem")
    n = li.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("line")).distinct().groupBy("actor").agg(F.count("*").alias("lines"), F.min("line").alias("first"))
    o = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("actor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op")).distinct()
    return o.join(n, "actor").groupBy("op").agg(F.sum("lines").alias("lines"), F.min("first").alias("first"))


@query("""WITH s AS (SELECT c_custkey AS slot, c_nationkey AS location, c_acctbal > 0 AS valid, md5(CAST(c_nationkey AS VARCHAR)) AS sha FROM customer), f AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 1 THEN 'x' ELSE md5(CAST(n_nationkey AS VARCHAR)) END AS sha FROM nation)
SELECT slot, location AS field FROM s JOIN f ON id = location AND s.sha = f.sha WHERE valid""")
def j33_save_fields(spark, d):
    """Valid save slots at a field whose pinned identity agrees."""
    md5 = lambda c: F.md5(c.cast("string").cast("binary"))
    s = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slot"), F.col("c_nationkey").alias("field"), md5(F.col("c_nationkey")).alias("sha"))
    n = F.col("n_nationkey")
    f = table(spark, d, "nation").select(n.alias("field"), F.when(n % 4 == 1, "x").otherwise(md5(n)).alias("sha"))
    return s.join(f, ["field", "sha"], "left_semi").select("slot", "field")


@query(EDGES + " SELECT o.face, CAST(o.slot AS INTEGER) AS slot, incidence, flags, seam FROM occ o JOIN edges USING (a, b)")
def t3_face_edges(spark, d):
    """Every side of every face with its edge's incidence, flags and seam status."""
    f = faces(spark, d)
    occ = topology.occurrences(f.select("face", *[f"{a}{i}" for i in range(3) for a in "xzh"]))
    return occ.join(topology.edges(f, WIDTH).select("a", "b", "incidence", "flags", "seam"), ["a", "b"]).select("face", "slot", "incidence", "flags", "seam")


@query(EDGES + """, own AS (SELECT a, b, face, least(x0, x1, x2) // 500 AS mesh FROM occ JOIN faces USING (face) WHERE a[1] = b[1] AND a[1] % 500 = 0 AND a[1] > 0 AND a[1] < 5000 AND face < 1000000000), n AS (SELECT a, b, count(*) AS owners, count(DISTINCT mesh) AS meshes FROM own GROUP BY a, b)
SELECT CASE WHEN owners = 2 AND meshes = 2 THEN 'sound' WHEN owners = 1 THEN 'one_side' ELSE 'odd' END AS status, count(*) AS edges FROM n GROUP BY 1""")
def t9_mesh_seams(spark, d):
    """Edges between meshes: sound where exactly two faces, one of each mesh, share them."""
    f = faces(spark, d).where("face < 1000000000")
    own = f.withColumn("mesh", F.floor(F.least("x0", "x1", "x2") / 500))
    occ = topology.occurrences(own).where("a.x = b.x AND a.x % 500 = 0 AND a.x > 0").where(F.col("a.x") < WIDTH)
    n = occ.groupBy("a", "b").agg(F.count("*").alias("owners"), F.count_distinct("mesh").alias("meshes"))
    return n.groupBy(F.expr("CASE WHEN owners = 2 AND meshes = 2 THEN 'sound' WHEN owners = 1 THEN 'one_side' ELSE 'odd' END").alias("status")).agg(F.count("*").alias("edges"))


@query("""WITH r AS (SELECT s_suppkey AS k, unnest(range(12)) AS g FROM supplier) SELECT k, CAST(g AS INTEGER) AS gateway, CAST(56 + 24 * g AS INTEGER) AS at, CAST((k * 3 + g) % 700 AS INTEGER) AS target, CAST((k + g) % 400 - 200 AS INTEGER) AS ax, CAST((k * g) % 5000 AS INTEGER) AS triangle FROM r WHERE (k + g) % 3 <> 0""")
def s14_gateways(spark, d):
    """Twelve gateway slots of a section; one whose target is 0x7FFF is absent."""
    k = F.col("s_suppkey")

    def slot(g: int):
        return F.concat(b.le((k + g) % 400 - 200, 2), F.lit("0000" * 7), b.le((k * g) % 5000, 2), b.le(F.when((k + g) % 3 == 0, 0x7FFF).otherwise((k * 3 + g) % 700), 2), F.lit("00000000"))

    raw = table(spark, d, "supplier").select(k.alias("k"), F.unhex(F.concat(F.lit("00" * 56), *[slot(g) for g in range(12)], F.lit("00" * 192))).alias("raw")).where(F.length("raw").isin(536, 740))
    at = lambda g: 56 + 24 * g
    each = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda g: F.struct(g.alias("gateway"), at(g).alias("at"), b.u16(F.col("raw"), at(g) + 18).alias("target"), b.i16(F.col("raw"), at(g)).alias("ax"), b.u16(F.col("raw"), at(g) + 16).alias("triangle")))
    return raw.select("k", F.explode(each).alias("g")).select("k", "g.*").where(f"target <> {0x7FFF}")


@query("""SELECT s_suppkey AS field, CAST(s_suppkey AS VARCHAR) || ',0x' || upper(to_hex(s_suppkey)) || ',' || s_name AS aliases, sha256('WM0/' || s_nationkey || '/' || s_suppkey % 16 || '/' || s_suppkey) AS identity FROM supplier""")
def f6_field_aliases(spark, d):
    """Names under which a field is found (decimal, hexadecimal, given name), and its source's identity key."""
    s = F.col("s_suppkey")
    key = F.concat_ws("/", F.lit("WM0"), F.col("s_nationkey").cast("string"), (s % 16).cast("string"), s.cast("string"))
    return table(spark, d, "supplier").select(s.alias("field"), F.concat_ws(",", s.cast("string"), F.concat(F.lit("0x"), F.hex(s)), "s_name").alias("aliases"), F.sha2(key, 256).alias("identity"))


@query("""WITH r AS (SELECT c_custkey AS k, (c_custkey * 997) % 9000 - 2000 AS x, c_custkey % 700 AS dx FROM customer) SELECT k, CAST(((x + dx) % 5000 + 5000) % 5000 AS BIGINT) AS east, CAST(floor((x + dx) / 5000.0) AS BIGINT) AS turns FROM r""")
def f58_moved_east(spark, d):
    """Positions moved east and brought around the map, with the turns that took."""
    c = F.col("c_custkey")
    x = (c * 997) % 9000 - 2000 + c % 700
    return table(spark, d, "customer").select(c.alias("k"), F.pmod(x, F.lit(WIDTH)).alias("east"), F.floor(x / float(WIDTH)).alias("turns"))


@query("SELECT o_orderkey AS k, o_custkey AS c, CAST(o_custkey % 20 AS INTEGER) AS scene FROM orders WHERE o_custkey % 20 = 7")
def k9_scene_spans(spark, d):
    """One scene out of a table written by scene: only its folder is read."""
    path = _shared(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_custkey") % 20).cast("int").alias("scene"))
    sinks.by_scene(o, "scene", path)
    return sinks.one_scene(spark, path, "scene", 7).select("k", "c", "scene")


@query("""SELECT c_nationkey AS place, count(*) AS rows, 'first' AS version FROM customer GROUP BY c_nationkey UNION ALL SELECT c_nationkey, count(*), 'second' FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey""")
def k11_published_versions(spark, d):
    """A table published twice and rolled back once: the current rows before and after."""
    root = _shared(spark)
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "place")
    sinks.publish(c.groupBy("place").agg(F.count("*").alias("rows")), root)
    sinks.publish(c.where("c_acctbal > 0").groupBy("place").agg(F.count("*").alias("rows")), root)
    second = sinks.current(spark, root)
    sinks.roll_back(spark, root)
    first = sinks.current(spark, root)
    return first.withColumn("version", F.lit("first")).union(second.withColumn("version", F.lit("second")))


@query("SELECT n_regionkey AS region, count(*) AS places, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def k8_csv_report(spark, d):
    """A report written as CSV and read back."""
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("places"), F.min("n_name").alias("first"))
    return sinks.report(rows, _shared(spark))


@query("""SELECT n_nationkey AS k, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def k4_json_lines(spark, d):
    """Rows as compact JSON with sorted keys, in order."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return sinks.canonical_json(n, ["n_nationkey"]).select(F.col("n_nationkey").alias("k"), "line")
