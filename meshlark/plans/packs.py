"""Queries over archives, packs and closed formats, entities that are searched and shown, and versions side by side."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlark.functions import binary as b
from meshlark.functions import search, sphere
from meshlark.operators import graph, tin
from meshlark.plans.catalog import _ARCS, EDGES, SURFACES, _arcs, _surface_points, query
from meshlark.plans.evidence import _OTHER, _other
from meshlark.plans.scripts import _PROGRAMS, _programs
from meshlark.plans.travel import _CALLS
from meshlark.sources import archives
from meshlark.sources.tables import faces, table

_MEMBERS = """WITH m AS (SELECT c_nationkey AS a, c_name AS name, c_mktsegment || c_custkey AS text, c_custkey AS k FROM customer), n AS (SELECT a, count(*) AS n FROM m GROUP BY a),
p AS (SELECT m.a, name, length(text) AS size, 16 + 27 * n + 3600 + 2 + 24 + coalesce(sum(24 + length(text)) OVER (PARTITION BY m.a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, text FROM m JOIN n USING (a))"""


@query(_MEMBERS + """ SELECT a, CASE WHEN a % 6 = 1 THEN 'broken' ELSE 'ok' END AS status, CASE WHEN a % 6 = 1 THEN '' ELSE name END AS name, CAST(CASE WHEN a % 6 = 1 THEN -1 ELSE place END AS BIGINT) AS place, CASE WHEN a % 6 = 1 THEN '' ELSE text END AS text FROM (SELECT * FROM p WHERE a % 6 <> 1 UNION ALL SELECT DISTINCT a, '', 0, 0, '' FROM p WHERE a % 6 = 1)""")
def s4_archive_members(spark, d):
    """Members of archives with their places and texts; an archive that is cut off is one error row."""
    c = table(spark, d, "customer")
    m = c.groupBy(F.col("c_nationkey").alias("a")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_name").alias("name"), F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("text")))).alias("m"))
    whole = F.unhex(archives.packed_archive(F.col("m")))
    files = m.select(F.col("a").cast("string").alias("path"), F.when(F.col("a") % 6 == 1, F.substring(whole, F.lit(1), F.length(whole) - 5)).otherwise(whole).alias("content"))
    found = archives.scan(files, "archive")
    return found.select(F.col("path").cast("int").alias("a"), F.when(F.col("error").isNull(), "ok").otherwise("broken").alias("status"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("place", F.lit(-1)).alias("place"), F.coalesce(F.decode("text", "UTF-8"), F.lit("")).alias("text"))


@query("""WITH r AS (SELECT n_nationkey AS f, unnest(range(15)) AS slot FROM nation) SELECT f, CAST(slot AS INTEGER) AS slot, CASE WHEN (f + slot) % 4 = 0 THEN 'empty' WHEN (f + slot) % 4 = 1 THEN 'checksum' ELSE 'valid' END AS status FROM r""")
def s23_save_slots(spark, d):
    """Fifteen slots of save files: empty, with a wrong checksum, or valid."""
    n = F.col("n_nationkey")
    body = lambda i: F.concat(F.lit("0000"), F.lpad(F.hex(n * 16 + i + 1), 8, "0"), F.repeat(F.lit("00"), F.lit(archives.SLOT - 8)))

    def slot(i: int):
        own = body(i)
        # the checksum is of what follows the first four bytes, so few bytes decide it
        stored = b.crc16(F.unhex(own), 2).bitwiseXOR(F.when((n + i) % 4 == 1, 1).otherwise(0))
        return F.when((n + i) % 4 == 0, F.repeat(F.lit("00"), F.lit(archives.SLOT))).otherwise(F.concat(b.le(stored, 2), own))

    short = F.concat(F.repeat(F.lit("00"), F.lit(archives.SLOT_HEAD)), *[slot(i) for i in range(archives.SLOTS)])
    files = table(spark, d, "nation").select(n.cast("string").alias("path"), F.unhex(short).alias("content"))
    return archives.scan(files, "slots").select(F.col("path").cast("int").alias("f"), "slot", "status")


@query("""WITH r AS (SELECT s_suppkey AS k, s_suppkey % 9 AS field FROM supplier) SELECT k, CAST(i AS INTEGER) AS record, CAST((k * 7 + i) % 2000 - 1000 AS INTEGER) AS x, CAST((k + i) % 300 AS INTEGER) AS triangle, CASE WHEN field < 5 THEN 'ok' ELSE 'missing_field' END AS status FROM (SELECT k, field, unnest(range(4)) AS i FROM r)""")
def s11_field_records(spark, d):
    """Paired records of twelve bytes with the field each leads to, checked against the names there are."""
    k = F.col("s_suppkey")
    record = lambda i: F.concat(b.le((k * 7 + i) % 2000 - 1000, 2), b.le(F.lit(0), 2), b.le((k + i) % 300, 2), b.le(k % 9, 2), b.le(F.lit(i), 1), F.lit("000000"))
    rows = table(spark, d, "supplier").select(k.alias("k"), F.unhex(F.concat(*[record(i) for i in range(4)])).alias("raw"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.length("raw") / 12).cast("int") - 1), lambda i: F.struct(i.alias("record"), b.i16(F.col("raw"), 12 * i).alias("x"), b.u16(F.col("raw"), 12 * i + 4).alias("triangle"), b.u16(F.col("raw"), 12 * i + 6).alias("field")))
    names = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("field"), F.lit(True).alias("known"))
    out = rows.select("k", F.explode(each).alias("r")).select("k", "r.*").join(F.broadcast(names), "field", "left")  # five regions
    return out.select("k", "record", "x", "triangle", F.when(F.col("known"), "ok").otherwise("missing_field").alias("status"))


@query(EDGES + _ARCS + " SELECT s AS src, t AS dst, CAST(w AS BIGINT) AS weight FROM arcs")
def k2_csr_pack(spark, d):
    """Arcs as compressed rows (offsets, neighbours, weights) in blocks of nodes, and unpacked again."""
    arcs = _arcs(spark, d).select("src", "dst", F.col("weight").cast("long").alias("weight"))
    rows = arcs.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("to"))
    block = rows.withColumn("block", F.floor(F.col("src") / 1024)).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("src", "to"))).alias("rows"))
    count = lambda upto: F.aggregate(F.slice("rows", 1, upto), F.lit(0), lambda n, r: n + F.size(r["to"]))
    packed = block.select("block", F.transform("rows", lambda r: r["src"]).alias("nodes"), F.transform(F.sequence(F.lit(0), F.size("rows")), count).alias("offsets"), F.flatten(F.transform("rows", lambda r: r["to"])).alias("to"))
    row = packed.select("to", "offsets", F.posexplode("nodes").alias("i", "src"))
    own = F.slice("to", F.get("offsets", F.col("i")) + 1, F.get("offsets", F.col("i") + 1) - F.get("offsets", F.col("i")))
    return row.select("src", F.explode(own).alias("x")).select("src", "x.dst", "x.weight")


@query("""WITH e AS (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id FROM events), t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown_key' WHEN 1 THEN 'missing_key' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'no_object' ELSE 'ok' END AS status FROM e) SELECT status, count(*) AS rows FROM t GROUP BY status""")
def s29_closed_schema(spark, d):
    """JSON rows against a closed schema: the first violation of each."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    text = F.when(n == 0, F.concat(F.lit('{"k": '), k, F.lit(', "extra": 1}'))).when(n == 1, "{}").when(n == 2, '{"k": "one"}').when(n == 3, F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit('{"k": '), k, F.lit("}")))
    keys = F.json_object_keys(F.col("t"))
    status = F.when(keys.isNull(), "no_object").when(F.size(F.array_except(keys, F.array(F.lit("k")))) > 0, "unknown_key").when(~F.array_contains(keys, "k"), "missing_key").when(~F.get_json_object("t", "$.k").rlike("^-?[0-9]+$"), "wrong_type").otherwise("ok")
    return table(spark, d, "events").select(text.alias("t")).select(status.alias("status")).groupBy("status").agg(F.count("*").alias("rows"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'hash_mismatch' WHEN p_partkey % 6 = 1 THEN 'invalid_payload' ELSE 'ok' END AS status, CAST(CASE WHEN p_partkey % 6 < 2 THEN -1 ELSE p_size END AS INTEGER) AS size FROM part""")
def s30_hashed_payloads(spark, d):
    """Resources that hold a payload as text with its own hash: read twice, and only where the hash agrees (also V5)."""
    k = F.col("p_partkey")
    payload = F.when(k % 6 == 1, F.concat(F.lit('{"size": '), F.col("p_size").cast("string"))).otherwise(F.to_json(F.struct(F.col("p_size").alias("size"))))
    sha = F.when(k % 6 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(payload, 256))
    outer = table(spark, d, "part").select(k.alias("k"), F.to_json(F.struct(payload.alias("payload"), sha.alias("sha256"))).alias("resource"))
    read = outer.select("k", F.from_json("resource", "payload string, sha256 string").alias("r"))
    inner = F.when(F.col("r.payload").endswith("}"), F.from_json("r.payload", "size int"))
    out = read.select("k", (F.sha2("r.payload", 256) == F.col("r.sha256")).alias("same"), inner.alias("p"))
    status = F.when(~F.col("same"), "hash_mismatch").when(F.col("p.size").isNull(), "invalid_payload").otherwise("ok")
    return out.select("k", status.alias("status"), F.when(status == "ok", F.col("p.size")).otherwise(-1).alias("size"))


@query("""SELECT face FROM (SELECT 2 * p_partkey AS face FROM part UNION ALL SELECT 2 * p_partkey + 1 FROM part)""")
def z14_section_rehash(spark, d):
    """Sections whose decoded columns, written again, have the hash of the bytes they came from."""
    names = [f"{a}{i}" for i in range(3) for a in "xzh"]
    write = F.unhex(F.concat(*[b.le(F.col(c), 4) for c in names]))
    raw = faces(spark, d).where("face < 1000000000").select("face", write.alias("raw")).select("face", "raw", F.sha2("raw", 256).alias("sha"))
    read = raw.select("face", "sha", *[b.u32(F.col("raw"), 4 * i).alias(c) for i, c in enumerate(names)])
    return read.where(F.sha2(write, 256) == F.col("sha")).select("face")


@query("""WITH e AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'minor' ELSE 'major' END AS level, CASE s_nationkey % 4 WHEN 0 THEN 'places' WHEN 1 THEN 'secrets' ELSE 'collectibles' END AS tag FROM supplier)
SELECT mode, category, count(*) AS entities, min(id) AS first FROM e, (VALUES ('hide-major'), ('show-all'), ('hide-all')) m(mode), (VALUES ('all'), ('places'), ('secrets'), ('collectibles')) c(category)
WHERE (mode = 'show-all' OR level = 'none' OR mode = 'hide-major' AND level = 'minor') AND (category = 'all' OR tag = category) GROUP BY ALL""")
def p9_visible_entities(spark, d):
    """Entities that show in each spoiler mode and category."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    level = F.when(s % 3 == 0, "none").when(s % 3 == 1, "minor").otherwise("major")
    tag = F.when(n % 4 == 0, "places").when(n % 4 == 1, "secrets").otherwise("collectibles")
    e = table(spark, d, "supplier").select(s.alias("id"), level.alias("level"), tag.alias("tag"))
    modes = F.when(F.col("level") == "none", F.array(F.lit("hide-major"), F.lit("show-all"), F.lit("hide-all"))).when(F.col("level") == "minor", F.array(F.lit("hide-major"), F.lit("show-all"))).otherwise(F.array(F.lit("show-all")))
    rows = e.select("id", "tag", F.explode(modes).alias("mode")).select("id", "mode", F.explode(F.array(F.lit("all"), F.col("tag"))).alias("category"))
    return rows.groupBy("mode", "category").agg(F.count("*").alias("entities"), F.min("id").alias("first"))


_OWNERS = "WITH o AS (SELECT 'location' AS kind, 0 AS bias, s_suppkey AS id, lower(s_name) AS name FROM supplier UNION ALL SELECT 'user-feature', 4, c_custkey, lower(c_name) FROM customer UNION ALL SELECT 'field', 5, n_nationkey, lower(n_name) FROM nation)"


@query(_OWNERS + """, q AS (SELECT unnest(['china', 'supplier#00000000', 'customer#000000012', 'uni', 'jappan']) AS q), r AS (SELECT q, kind, id, name, CASE WHEN name = q THEN 0 WHEN starts_with(name, q) THEN 10 WHEN contains(name, q) THEN 20 WHEN length(q) >= 4 AND levenshtein(name, q) <= 1 THEN 40 END + bias AS score FROM o, q)
SELECT q, kind, id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score, name, id) AS INTEGER) AS rank FROM r WHERE score IS NOT NULL""")
def o4_navigation_search(spark, d):
    """Entries of three owners in one order: ten points a tier and a small one for the kind."""
    rows = lambda t, kind, bias, id_, name: table(spark, d, t).select(F.lit(kind).alias("kind"), F.lit(bias).alias("bias"), F.col(id_).cast("long").alias("id"), search.collapsed(F.col(name)).alias("name"))
    o = rows("supplier", "location", 0, "s_suppkey", "s_name").union(rows("customer", "user-feature", 4, "c_custkey", "c_name")).union(rows("nation", "field", 5, "n_nationkey", "n_name"))
    r = o.withColumn("q", F.explode(F.array(*[F.lit(x) for x in ("china", "supplier#00000000", "customer#000000012", "uni", "jappan")])))
    n, q = F.col("name"), F.col("q")
    tier = F.when(n == q, 0).when(n.startswith(q), 10).when(n.contains(q), 20).when((F.length(q) >= 4) & (F.levenshtein(n, q, 1) >= 0), 40)
    r = r.withColumn("score", tier + F.col("bias")).where("score IS NOT NULL")
    return r.select("q", "kind", "id", "score", F.row_number().over(Window.partitionBy("q").orderBy("score", "name", "id")).alias("rank"))


@query("""WITH f AS (SELECT l_suppkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'minor' ELSE 'major' END AS level, CASE WHEN l_returnflag = 'A' THEN 'old road' WHEN l_returnflag = 'N' THEN 'new bridge' ELSE 'red gate' END AS text FROM lineitem), w AS (SELECT id, unnest(string_split(text, ' ')) AS term FROM f WHERE level <> 'major')
SELECT id, count(DISTINCT term) AS terms, min(term) AS first FROM w GROUP BY id""")
def f5_fact_terms(spark, d):
    """Search terms of the facts that a reader may see."""
    text = F.when(F.col("l_returnflag") == "A", "old road").when(F.col("l_returnflag") == "N", "new bridge").otherwise("red gate")
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_linenumber") % 3 != 2).alias("seen"), text.alias("text")).where("seen")
    return f.select("id", F.explode(F.split("text", " ")).alias("term")).groupBy("id").agg(F.count_distinct("term").alias("terms"), F.min("term").alias("first"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS o FROM lineitem WHERE l_returnflag <> 'R'), c AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS o FROM lineitem WHERE l_linestatus <> 'F' OR l_returnflag = 'A'),
j AS (SELECT coalesce(a.k, c.k) AS k, a.o IS NULL AS right_only, c.o IS NULL AS left_only FROM a FULL JOIN c ON a.k = c.k AND a.o = c.o) SELECT k, CASE WHEN bool_or(left_only) AND bool_or(right_only) THEN 'both_differ' WHEN bool_or(left_only) THEN 'left_more' WHEN bool_or(right_only) THEN 'right_more' ELSE 'equal' END AS status FROM j GROUP BY k""")
def u8_set_equality(spark, d):
    """Owners of records by two accounts: equal sets, or which one has more."""
    li = table(spark, d, "lineitem")
    side = lambda rows, name: rows.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("o"), F.lit(True).alias(name)).distinct()
    j = side(li.where("l_returnflag <> 'R'"), "a").join(side(li.where("l_linestatus <> 'F' OR l_returnflag = 'A'"), "c"), ["k", "o"], "full")
    left, right = F.max(F.col("c").isNull()), F.max(F.col("a").isNull())
    return j.groupBy("k").agg(F.when(left & right, "both_differ").when(left, "left_more").when(right, "right_more").otherwise("equal").alias("status"))


#: The same points over the other version of the surface, the steps under names of their own.
_BOTH = _OTHER.split(",\nu AS")[0] + "," + SURFACES[SURFACES.index(" q AS (") :] + ",\n" + re.sub(r"\b(fb|fx|fz|m|w|h|wall|side|side2|met|hv|every|surfaces)\b(?! AS \w+\b(?!\())(?=\.| AS \(|\)| WHERE| JOIN| USING| GROUP| UNION|,? ON)", r"\1_2", SURFACES[SURFACES.index("fb AS (") :].replace("FROM faces)", "FROM alt)", 1))


@query(_BOTH + """, n AS (SELECT qid, count(*) AS base, any_value(low_n) AS n, any_value(low_d) AS d, bool_and(kind IN ('inside', 'boundary')) AS plain FROM surfaces GROUP BY qid), n2 AS (SELECT qid, count(*) AS other, any_value(low_n) AS n2, any_value(low_d) AS d2, bool_and(kind IN ('inside', 'boundary')) AS plain2 FROM surfaces_2 GROUP BY qid)
SELECT qid, coalesce(base, 0) AS base, coalesce(other, 0) AS other, CASE WHEN base = 1 AND other = 1 AND plain AND plain2 THEN CASE WHEN n * d2 = n2 * d THEN 'same_height' ELSE 'moved' END ELSE 'not_comparable' END AS status FROM n FULL JOIN n2 USING (qid)""")
def v6_two_versions(spark, d):
    """Points over both versions of a surface: hits in each, and whether single ordinary heights differ."""
    points = _surface_points(spark, d)

    def hits(f, count, n, den, plain):
        g = tin.surfaces_at(f, points).groupBy("qid")
        return g.agg(F.count("*").alias(count), F.first("low_n").alias(n), F.first("low_d").alias(den), F.min(F.col("kind").isin("inside", "boundary")).alias(plain))

    j = hits(faces(spark, d), "base", "n", "d", "plain").join(hits(_other(spark, d), "other", "n2", "d2", "plain2"), "qid", "full")
    single = F.expr("base = 1 AND other = 1 AND plain AND plain2")
    return j.select("qid", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("other", F.lit(0)).alias("other"), F.when(single, F.when(F.expr("n * d2 = n2 * d"), "same_height").otherwise("moved")).otherwise("not_comparable").alias("status"))


@query("""WITH s AS (SELECT l_orderkey AS scene, bool_and(l_linestatus = 'O') AS complete, bool_and(l_discount < 0.08) AS literal, count(*) AS grants FROM lineitem GROUP BY l_orderkey) SELECT scene, CASE WHEN NOT complete THEN 'partial' WHEN literal THEN 'static' ELSE 'variable' END AS status, CASE WHEN complete AND literal THEN grants ELSE 0 END AS static_grants FROM s""")
def x8_gameplay_status(spark, d):
    """Scenes whose grants are certain: only with a complete program and literal operands throughout."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.min(F.col("l_linestatus") == "O").alias("complete"), F.min(F.expr("l_discount < 0.08")).alias("literal"), F.count("*").alias("grants"))
    return s.select("scene", F.when(~F.col("complete"), "partial").when(F.col("literal"), "static").otherwise("variable").alias("status"), F.when(F.col("complete") & F.col("literal"), F.col("grants")).otherwise(0).alias("static_grants"))


@query(_PROGRAMS + """, r AS (SELECT i.k, min(pc) FILTER (op % 8 = 0) AS ret FROM i JOIN g USING (k) WHERE NOT g.bad GROUP BY i.k), m AS (SELECT r.k, min(pc) AS main FROM r JOIN i ON i.k = r.k AND pc > ret GROUP BY r.k) SELECT r.k, CAST(coalesce(ret, -1) AS INTEGER) AS ret, CAST(coalesce(main, -1) AS INTEGER) AS main FROM r LEFT JOIN m USING (k)""")
def w10_main_entry(spark, d):
    """The instruction after the first return of each program, where its main part begins."""
    p = _programs(spark, d).where("status = 'ok'")
    after = F.lead("pc").over(Window.partitionBy("k").orderBy("pc"))
    ends = F.when(F.col("op") % 8 == 0, F.struct("pc", "after"))
    m = p.withColumn("after", after).groupBy("k").agg(F.min(ends).alias("x"))
    return m.select("k", F.coalesce("x.pc", F.lit(-1)).alias("ret"), F.coalesce("x.after", F.lit(-1)).alias("main"))


@query("""WITH p AS (SELECT p_partkey AS k, (p_partkey % 36) * 10 - 180.0 AS lon, (p_partkey % 15) * 8 - 60.0 AS lat FROM part), e AS (SELECT k, lon, lat, radians(4.0) AS w FROM p)
SELECT k, round(2 * 6371008.8 / 1000 * (2 * asin(sqrt(power(sin(w / 2), 2))) + asin(cos(radians(lat)) * sin(w / 2)) + asin(cos(radians(lat + 4)) * sin(w / 2))), 4) AS perimeter_km, lon AS west, lon + 4 AS east, lat AS south, lat + 4 AS north FROM e""")
def a29_feature_measurements(spark, d):
    """Perimeter and bounds of drawn polygons (also F52: bounds)."""
    k = F.col("p_partkey")
    lon, lat = (k % 36 * 10 - 180).cast("double"), (k % 15 * 8 - 60).cast("double")
    corners = [(lon, lat), (lon + 4, lat), (lon + 4, lat + 4), (lon, lat + 4)]
    ring = F.array(*[F.struct(a.alias("lon"), c.alias("lat")) for a, c in corners])
    rows = table(spark, d, "part").select(k.alias("k"), ring.alias("r"))
    side = lambda p, i: sphere.haversine(p["lon"], p["lat"], F.get("r", (i + 1) % F.size("r"))["lon"], F.get("r", (i + 1) % F.size("r"))["lat"])
    length = F.aggregate(F.transform("r", side), F.lit(0.0), lambda s, x: s + x)
    of = lambda f: F.transform("r", lambda p: p[f])
    return rows.select("k", F.round(length / 1000, 4).alias("perimeter_km"), F.array_min(of("lon")).alias("west"), F.array_max(of("lon")).alias("east"), F.array_min(of("lat")).alias("south"), F.array_max(of("lat")).alias("north"))


@query("""WITH g AS (SELECT c_custkey AS guide, [c_nationkey, c_custkey % 25, (c_custkey * 3) % 25] AS fields FROM customer), s AS (SELECT n_regionkey AS scene, list(n_nationkey) AS fields FROM nation GROUP BY n_regionkey)
SELECT scene, count(*) AS guides, min(guide) AS first FROM g, s WHERE list_has_any(g.fields, s.fields) GROUP BY scene""")
def z9_related_guides(spark, d):
    """Guides that name any of a scene's fields, each once."""
    c = F.col("c_custkey")
    g = table(spark, d, "customer").select(c.alias("guide"), F.explode(F.array(F.col("c_nationkey").cast("long"), c % 25, (c * 3) % 25)).alias("field"))
    s = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("field"), F.col("n_regionkey").alias("scene"))
    return g.join(s, "field").select("guide", "scene").distinct().groupBy("scene").agg(F.count("*").alias("guides"), F.min("guide").alias("first"))


@query("""WITH t AS (SELECT p_partkey AS id, p_size % 26 AS field, 'script' AS origin FROM part UNION ALL SELECT -1 - s_suppkey, s_nationkey, 'engine' FROM supplier), n AS (SELECT n_nationkey AS field, n_regionkey AS map FROM nation)
SELECT origin, coalesce(map, -1) AS map, CASE WHEN map IS NULL THEN 'unresolved' WHEN map = 0 THEN 'same_map' ELSE 'cross_map' END AS status, count(*) AS transitions FROM t LEFT JOIN n USING (field) GROUP BY ALL""")
def x5_map_transitions(spark, d):
    """Transitions of scripts and of the engine by the map they lead to."""
    t = table(spark, d, "part").select((F.col("p_size") % 26).cast("int").alias("field"), F.lit("script").alias("origin")).union(table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("field"), F.lit("engine").alias("origin")))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("field"), F.col("n_regionkey").alias("map"))
    status = F.when(F.col("map").isNull(), "unresolved").when(F.col("map") == 0, "same_map").otherwise("cross_map")
    return t.join(n, "field", "left").groupBy("origin", F.coalesce("map", F.lit(-1)).alias("map"), status.alias("status")).agg(F.count("*").alias("transitions"))


@query("""WITH f AS (SELECT p_partkey // 10 AS d, unnest(CASE p_partkey % 10 WHEN 0 THEN ['Data/WM/wm0.map'] WHEN 1 THEN CASE WHEN (p_partkey // 10) % 4 = 1 THEN ['notes.txt'] ELSE ['data/field/flevel.LGP'] END WHEN 2 THEN CASE WHEN (p_partkey // 10) % 4 = 2 THEN ['copy/data/wm/WM0.MAP'] ELSE ['readme'] END ELSE ['x' || p_partkey] END) AS path FROM part),
c AS (SELECT d, count(*) FILTER (lower(path) LIKE '%data/wm/wm0.map') AS maps, count(*) FILTER (lower(path) LIKE '%data/field/flevel.lgp') AS archives FROM f GROUP BY d) SELECT d, CASE WHEN maps = 0 THEN 'none' WHEN maps > 1 THEN 'several' WHEN archives = 0 THEN 'incomplete' ELSE 'found' END AS status, maps, archives FROM c""")
def s1_located_datasets(spark, d):
    """Selections of files with exactly one dataset by its paths, whatever their case; none, several or an incomplete one are rejected."""
    k = F.col("p_partkey")
    group, turn = F.floor(k / 10), k % 10
    path = F.when(turn == 0, "Data/WM/wm0.map").when(turn == 1, F.when(group % 4 == 1, "notes.txt").otherwise("data/field/flevel.LGP")).when(turn == 2, F.when(group % 4 == 2, "copy/data/wm/WM0.MAP").otherwise("readme")).otherwise(F.concat(F.lit("x"), k.cast("string")))
    files = table(spark, d, "part").select(group.alias("d"), F.lower(path).alias("path"))
    c = files.groupBy("d").agg(F.count_if(F.col("path").endswith("data/wm/wm0.map")).alias("maps"), F.count_if(F.col("path").endswith("data/field/flevel.lgp")).alias("archives"))
    return c.withColumn("status", F.when(F.col("maps") == 0, "none").when(F.col("maps") > 1, "several").when(F.col("archives") == 0, "incomplete").otherwise("found"))


@query(_CALLS + """, w(root, callee, depth) AS (SELECT a, b, 1 FROM e UNION SELECT root, b, depth + 1 FROM w JOIN e ON callee = a WHERE depth < 16), o AS (SELECT DISTINCT root, callee FROM w)
SELECT root // 50 AS manifest, count(DISTINCT root) AS assets, count(*) FILTER (root = callee) AS cyclic, count(*) FILTER (root = callee) = 0 AS accepted FROM o GROUP BY 1""")
def s31_manifest_cycles(spark, d):
    """Manifests whose assets depend on each other in a circle are rejected."""
    k = F.col("p_partkey")
    needs = F.when(k % 3 < 2, F.array(*[50 * F.floor(k / 50) + (k * 5 + s * 17) % 50 for s in range(2)]))
    edges = table(spark, d, "part").select(k.alias("caller"), F.explode(needs).alias("callee")).distinct()
    found = graph.calls(edges, edges.select(F.col("caller").alias("root")).distinct())
    c = found.groupBy(F.floor(F.col("root") / 50).alias("manifest")).agg(F.count_distinct("root").alias("assets"), F.count_if(F.expr("root = callee")).alias("cyclic"))
    return c.withColumn("accepted", F.col("cyclic") == 0)


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS kind, (p_partkey % 36) * 10.0 AS lon FROM part)
SELECT k, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'no_hemisphere' ELSE 'repeated_vertex' END AS status, 0.0::DOUBLE AS skew FROM p""")
def f48_user_polygons(spark, d):
    """Drawn polygons must be simple and lie within less than half the sphere; the status of each, and by how much its area depends on where it starts."""
    k = F.col("p_partkey")
    lon = (k % 36 * 10).cast("double")
    lat = F.when(k % 3 == 0, -60.0).otherwise(0.0)
    point = lambda a: F.struct(a.alias("lon"), lat.alias("lat"))
    ring = lambda turn: F.array(*[point(lon + 120 * ((i + turn) % 3)) for i in range(3)])
    closed = F.when(k % 3 == 2, F.array(point(lon), point(lon + 20), point(lon))).otherwise(ring(0))
    rows = table(spark, d, "part").select(k.alias("k"), sphere.polygon(closed, 1000.0, hemisphere=True).alias("a"), sphere.polygon(F.when(k % 3 == 2, closed).otherwise(ring(1)), 1000.0, hemisphere=True).alias("b"))
    return rows.select("k", F.col("a.status").alias("status"), (F.round(F.col("a.area") - F.col("b.area"), 3) + 0.0).alias("skew"))


_STATUSES = (("l_linenumber = 7", "empty"), ("l_returnflag = 'A' AND l_linenumber > 4", "checksum"), ("l_partkey % 19 = 0", "other_module"), ("p_partkey IS NULL", "unknown_field"), ("p_size > 48", "source_mismatch"), ("l_quantity > 49", "triangle_out_of_range"), ("l_discount > 0.09", "ambiguous"))


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS k, CASE {" ".join(f"WHEN {c} THEN '{w}'" for c, w in _STATUSES)} ELSE 'inside' END AS status FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_suppkey % 7 <> 3""")
def z10_save_positions(spark, d):
    """Positions of save slots on their field: the first of the ordered reasons against each, or inside."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_size")
    j = li.join(p, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_suppkey") % 7 != 3), "left")
    status = None
    for condition, word in _STATUSES:
        status = F.when(F.expr(condition), word) if status is None else status.when(F.expr(condition), word)
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), status.otherwise("inside").alias("status"))
