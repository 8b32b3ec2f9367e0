"""Queries that write rows as binary records and decode them; their SQL says from the rows what decoding must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions import binary as b
from meshlark.plans.catalog import query
from meshlark.sources.tables import table


def _part(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("n"))


#: Byte i of a hex string, for DuckDB.
def _byte(h: str, i: str) -> str:
    digit = lambda at: f"(strpos('0123456789abcdef', substr({h}, {at}, 1)) - 1)"
    return f"(16 * {digit(f'2 * ({i}) + 1')} + {digit(f'2 * ({i}) + 2')})"


_FOLD = "(CASE WHEN {0} & 32768 <> 0 THEN (({0} << 1) & 65535) # 4129 ELSE ({0} << 1) & 65535 END)"


def _xor(a: str, c: str) -> str:
    return f"xor({a}, {c})"


@query(f"""WITH RECURSIVE h AS (SELECT p_partkey AS k, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part),
c(k, h, bit, crc) AS (SELECT k, h, 32, CAST(65535 AS INTEGER) FROM h UNION ALL
  SELECT k, h, bit + 1, CASE WHEN (CASE WHEN bit % 8 = 0 THEN xor(crc, {_byte('h', 'bit // 8')} * 256) ELSE crc END) & 32768 <> 0
    THEN xor(((CASE WHEN bit % 8 = 0 THEN xor(crc, {_byte('h', 'bit // 8')} * 256) ELSE crc END) << 1) & 65535, 4129) ELSE ((CASE WHEN bit % 8 = 0 THEN xor(crc, {_byte('h', 'bit // 8')} * 256) ELSE crc END) << 1) & 65535 END FROM c WHERE bit < 128)
SELECT k, CAST(xor(crc, 65535) AS INTEGER) AS checksum FROM c WHERE bit = 128""")
def f70_checksum(spark, d):
    """CRC-16 of records without their first four bytes."""
    raw = F.unhex(F.md5(F.col("k").cast("string").cast("binary")))
    return _part(spark, d).select("k", b.crc16(raw, 4).alias("checksum"))


_SAVE = "WITH r AS (SELECT p_partkey AS k, (p_partkey * 2654435761) % 4294967296 AS a, (p_partkey * 40503 + p_size * 65599) % 4294967296 AS c, p_size % 32 AS model FROM part)"


@query(_SAVE + """, u AS (SELECT k, model, a & 524287 AS x, c & 262143 AS z, c >> 18 AS height, (a >> 19) & 31 AS held, a >> 24 AS heading FROM r)
SELECT k, CAST(x AS BIGINT) AS x, CAST(z AS BIGINT) AS z, CAST(height AS BIGINT) AS height, CAST(heading AS BIGINT) AS heading, CAST(held AS INTEGER) AS held,
  CASE WHEN held <> model THEN 'other_model' WHEN x >= 294912 OR z >= 229376 THEN 'outside' ELSE 'bound' END AS status FROM u""")
def f71_world_record(spark, d):
    """Packed positions taken apart, and bound to the current model only where they hold it and lie on the map."""
    k, n = F.col("k"), F.col("n")
    rows = _part(spark, d).select("k", (n % 32).cast("int").alias("model"), F.unhex(F.concat(b.le((k * 2654435761) % 4294967296, 4), b.le((k * 40503 + n * 65599) % 4294967296, 4))).alias("raw"))
    a, c = b.u32(F.col("raw"), 0), b.u32(F.col("raw"), 4)
    out = rows.select("k", "model", a.bitwiseAND(0x7FFFF).alias("x"), c.bitwiseAND(0x3FFFF).alias("z"), F.shiftright(c, 18).alias("height"), F.shiftright(a, 24).alias("heading"), F.shiftright(a, 19).bitwiseAND(31).cast("int").alias("held"))
    status = F.when(F.col("held") != F.col("model"), "other_model").when(F.expr("x >= 294912 OR z >= 229376"), "outside").otherwise("bound")
    return out.withColumn("status", status).drop("model")


@query("""WITH r AS (SELECT p_partkey AS k, [88, 91, 112, 128, 130, 131, 17][1 + p_partkey % 7] AS op, p_size % 16 AS b1, (p_size // 3) % 16 AS b2, (p_partkey * 31) % 65536 AS v FROM part),
o AS (SELECT k, 'item' AS name, b1 AS bank, v AS value FROM r WHERE op = 88 UNION ALL SELECT k, 'quantity', b2, v % 256 FROM r WHERE op = 88 UNION ALL SELECT k, 'formation', b2, v FROM r WHERE op = 112
  UNION ALL SELECT k, 'materia', b1, v // 256 FROM r WHERE op = 91 UNION ALL SELECT k, 'ap0', b2, v % 256 FROM r WHERE op = 91 UNION ALL SELECT k, 'ap1', (v % 256) // 16, 7 FROM r WHERE op = 91 UNION ALL SELECT k, 'ap2', v % 16, 9 FROM r WHERE op = 91
  UNION ALL SELECT k, 'target', b1, v % 256 FROM r WHERE op >= 128 UNION ALL SELECT k, CASE WHEN op = 128 THEN 'value' ELSE 'bit' END, b2, v // 256 FROM r WHERE op >= 128)
SELECT k, name, CASE WHEN name = 'target' OR bank <> 0 THEN 'variable' ELSE 'literal' END AS kind, CAST(bank AS INTEGER) AS bank, CAST(value AS INTEGER) AS value FROM o""")
def f73_gameplay_operands(spark, d):
    """Operands of instructions of known width; an unknown opcode gives none."""
    k, n = F.col("k"), F.col("n")
    rows = _part(spark, d).select("k", F.element_at(F.array(*[F.lit(x) for x in (88, 91, 112, 128, 130, 131, 17)]), (k % 7 + 1).cast("int")).alias("op"), ((n % 16) * 16 + F.floor(n / 3) % 16).alias("bank"), ((k * 31) % 65536).alias("v"))
    v, head = F.col("v"), F.concat(b.le(F.col("op"), 1), b.le(F.col("bank"), 1))
    raw = F.when(F.col("op") == 88, F.concat(head, b.le(v, 2), b.le(v % 256, 1))).when(F.col("op") == 91, F.concat(head, b.le(v, 2), b.le(v % 256, 1), F.lit("0709"))).otherwise(F.concat(head, b.le(v, 2)))
    return rows.select("k", F.explode(b.gameplay_operands(F.unhex(raw))).alias("o")).select("k", "o.*")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, [48, 64, 65, 80, 81, 96, 97, 98, 99, 112, 113, 128, 160, 176, 192, 5][1 + l_orderkey % 16] AS op, CAST(l_partkey * 7919 - 1000000 AS BIGINT) AS a, CAST(CASE WHEN l_orderkey % 16 IN (3, 4) THEN l_suppkey % 34 ELSE l_suppkey * 104729 - 5000000 END AS BIGINT) AS b FROM lineitem),
v AS (SELECT k, CASE op WHEN 48 THEN a * b WHEN 64 THEN a + b WHEN 65 THEN a - b WHEN 80 THEN CASE WHEN b BETWEEN 0 AND 31 THEN a * CAST(pow(2, b) AS BIGINT) END WHEN 81 THEN CASE WHEN b BETWEEN 0 AND 31 THEN CAST(floor(a / pow(2, b)) AS BIGINT) END
  WHEN 96 THEN CAST(a < b AS BIGINT) WHEN 97 THEN CAST(a > b AS BIGINT) WHEN 98 THEN CAST(a <= b AS BIGINT) WHEN 99 THEN CAST(a >= b AS BIGINT) WHEN 112 THEN CAST(a = b AS BIGINT) WHEN 113 THEN CAST(a <> b AS BIGINT) WHEN 128 THEN a & b WHEN 160 THEN a | b
  WHEN 176 THEN CAST(a <> 0 AND b <> 0 AS BIGINT) WHEN 192 THEN CAST(a <> 0 OR b <> 0 AS BIGINT) END AS v FROM r)
SELECT k, v IS NOT NULL AS defined, coalesce(((v + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0) AS value FROM v""")
def f76_literal_operators(spark, d):
    """The bytecode's binary operators on literals, wrapped to 32 bits, where they are defined."""
    li = table(spark, d, "lineitem")
    k, turn = F.col("l_orderkey"), (F.col("l_orderkey") % 16).cast("int")
    ops = F.array(*[F.lit(x) for x in (48, 64, 65, 80, 81, 96, 97, 98, 99, 112, 113, 128, 160, 176, 192, 5)])
    second = F.when(turn.isin(3, 4), F.col("l_suppkey") % 34).otherwise(F.col("l_suppkey") * 104729 - 5000000).cast("long")
    rows = li.select((k * 10 + F.col("l_linenumber")).alias("k"), F.element_at(ops, turn + 1).alias("op"), (F.col("l_partkey") * 7919 - 1000000).cast("long").alias("a"), second.alias("b"))
    return rows.select("k", b.applied(F.col("op"), F.col("a"), F.col("b")).alias("v")).select("k", F.col("v").isNotNull().alias("defined"), F.coalesce("v", F.lit(0)).alias("value"))


@query("""WITH r AS (SELECT p_partkey AS k, p_size % 256 AS f, (p_partkey * 37) % 256 AS g, p_partkey % 4 AS mode FROM part) SELECT k, CAST(CASE mode WHEN 1 THEN least(255, g + f * 3) WHEN 2 THEN greatest(0, g - f * 3) ELSE -1 END AS BIGINT) AS value FROM r""")
def f28_blended(spark, d):
    """Saturating sums and clamped differences of channels, -1 for another mode."""
    return _part(spark, d).select("k", F.coalesce(b.blended((F.col("k") * 37) % 256, F.col("n") % 256 * 3, F.col("k") % 4), F.lit(-1)).cast("long").alias("value"))


_CAMERA = """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey % 400 - 200 AS x, l_suppkey % 300 - 150 AS y, l_orderkey % 500 - 100 AS z, l_linenumber = 7 AS missing FROM lineitem),
q AS (SELECT k, missing, (4096 * x - 512 * y) / 4096.0 + 10 AS qx, (512 * x + 4000 * y) / 4096.0 - 20 AS qy, (100 * x + 4096 * z) / 4096.0 + 50 AS qz FROM r)"""


def _camera_points(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") % 400 - 200).alias("x"), (F.col("l_suppkey") % 300 - 150).alias("y"), (F.col("l_orderkey") % 500 - 100).alias("z"), (F.col("l_linenumber") == 7).alias("missing"))
    return rows.withColumn("at", screen_of(F.col("x"), F.col("y"), F.col("z"), (4096, -512, 0, 512, 4000, 0, 100, 0, 4096), (10, -20, 50), 300))


def screen_of(x, y, z, matrix: tuple[int, ...], translation: tuple[int, ...], zoom: int):
    """Place on the screen (sx, sy) and depth of a point under a camera with a Q12 matrix; no place at a depth of 1e-6 or less."""
    q = [F.lit(t) + sum(m * v for m, v in zip(matrix[3 * i : 3 * i + 3], (x, y, z), strict=True)) / F.lit(4096.0) for i, t in enumerate(translation)]
    ahead = q[2] > 1e-6
    return F.struct(F.when(ahead, zoom * q[0] / q[2]).alias("sx"), F.when(ahead, zoom * q[1] / q[2]).alias("sy"), q[2].alias("depth"))


@query(_CAMERA + """ SELECT k, CASE WHEN missing THEN 'missing_camera' WHEN qz <= 1e-6 THEN 'invalid_depth' ELSE 'valid' END AS reason, round(CASE WHEN NOT missing AND qz > 1e-6 THEN 300 * qx / qz END, 6) AS sx, round(CASE WHEN NOT missing AND qz > 1e-6 THEN 300 * qy / qz END, 6) AS sy,
  coalesce(CASE WHEN NOT missing AND qz > 1e-6 THEN 300 * qx / qz < -160 OR 300 * qx / qz >= 160 OR 300 * qy / qz < -120 OR 300 * qy / qz >= 120 END, false) AS outside,
  round(CASE WHEN NOT missing AND qz > 1e-6 THEN 40 + (300 * qx / qz + 160) * 640 / 320 END, 5) AS px, round(CASE WHEN NOT missing AND qz > 1e-6 THEN 10 + (300 * qy / qz + 120) * 480 / 240 END, 5) AS py FROM q""")
def f27_projection_diagnostic(spark, d):
    """Points on the screen with the reason where there is none, whether they lie off the background, and their reference pixel."""
    rows = _camera_points(spark, d)
    reason = F.when(F.col("missing"), "missing_camera").when(F.col("at.sx").isNull(), "invalid_depth").otherwise("valid")
    sx, sy = F.when(~F.col("missing"), F.col("at.sx")), F.when(~F.col("missing"), F.col("at.sy"))
    pixel = lambda s, origin, low, wide, size: origin + (s - low) * wide / size
    out = rows.select("k", reason.alias("reason"), sx.alias("sx"), sy.alias("sy")).withColumn("outside", F.expr("coalesce(sx < -160 OR sx >= 160 OR sy < -120 OR sy >= 120, false)"))
    return out.select("k", "reason", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), "outside", F.round(pixel(F.col("sx"), 40, -160, 640, 320), 5).alias("px"), F.round(pixel(F.col("sy"), 10, -120, 480, 240), 5).alias("py"))


@query("""WITH r AS (SELECT p_partkey AS k, p_size % 40 AS mx, (p_size * 7) % 30 AS mz, (p_partkey * 911) % 20000 AS x, (p_partkey * 577) % 20000 AS z, ['WM0', 'WM2', 'WM3'][1 + p_partkey % 3] AS m FROM part),
w AS (SELECT *, CASE m WHEN 'WM0' THEN mx < 36 AND mz < 28 WHEN 'WM2' THEN mx BETWEEN 12 AND 23 AND mz BETWEEN 8 AND 23 ELSE mx < 8 AND mz < 8 END AS good FROM r)
SELECT k, m AS map, CAST(CASE WHEN good THEN mx * 8192 + x % 8192 ELSE -1 END AS BIGINT) AS px, CAST(CASE WHEN good THEN mz * 8192 + z % 8192 ELSE -1 END AS BIGINT) AS pz, CAST(x + CASE WHEN m = 'WM2' THEN 98304 ELSE 0 END AS BIGINT) AS ex, CAST(z + CASE WHEN m = 'WM2' THEN 65536 ELSE 0 END AS BIGINT) AS ez, CAST(x AS BIGINT) AS nx FROM w""")
def z29_engine_positions(spark, d):
    """Script points placed by their mesh (-1 outside the map), engine positions of archive places and back."""
    k, n = F.col("k"), F.col("n")
    rows = _part(spark, d).select("k", F.element_at(F.array(F.lit("WM0"), F.lit("WM2"), F.lit("WM3")), (k % 3 + 1).cast("int")).alias("map"), (n % 40).alias("mx"), ((n * 7) % 30).alias("mz"), ((k * 911) % 20000).alias("x"), ((k * 577) % 20000).alias("z"))
    bounds = {"WM0": (0, 36, 0, 28), "WM2": (12, 24, 8, 24), "WM3": (0, 8, 0, 8)}
    good = F.lit(False)
    for name, (x0, x1, z0, z1) in bounds.items():
        good = good | ((F.col("map") == name) & F.col("mx").between(x0, x1 - 1) & F.col("mz").between(z0, z1 - 1))
    deep = F.col("map") == "WM2"
    placed = rows.select("k", "map", F.when(good, F.col("mx") * 8192 + F.col("x").bitwiseAND(8191)).otherwise(-1).alias("px"), F.when(good, F.col("mz") * 8192 + F.col("z").bitwiseAND(8191)).otherwise(-1).alias("pz"), (F.col("x") + F.when(deep, 98304).otherwise(0)).alias("ex"), (F.col("z") + F.when(deep, 65536).otherwise(0)).alias("ez"))
    return placed.withColumn("nx", F.col("ex") - F.when(deep, 98304).otherwise(0))


@query("""SELECT p_partkey AS k, CAST(p_partkey % 32 AS INTEGER) AS terrain, CAST(p_size % 8 AS INTEGER) AS script, CAST((p_partkey // 7) % 32 AS INTEGER) AS region, CAST((p_partkey * 3) % 512 AS INTEGER) AS texture, p_size % 2 = 1 AS chocobo, CAST((p_partkey // 3) % 2 AS INTEGER) AS bit14 FROM part""")
def p3_packed_attributes(spark, d):
    """Attributes of faces out of their packed bytes."""
    k, n = F.col("k"), F.col("n")
    ids = (k * 3) % 512 + 512 * (F.floor(k / 7) % 32) + 16384 * (F.floor(k / 3) % 2) + 32768 * (n % 2)
    rows = _part(spark, d).select("k", F.unhex(F.concat(b.le(k % 32 + 32 * (n % 8), 1), b.le(ids, 2))).alias("raw"))
    first, word = b.u8(F.col("raw"), 0), b.u16(F.col("raw"), 1)
    return rows.select("k", first.bitwiseAND(31).alias("terrain"), F.shiftright(first, 5).alias("script"), F.shiftright(word, 9).bitwiseAND(31).alias("region"), word.bitwiseAND(511).alias("texture"), (word >= 32768).alias("chocobo"), F.shiftright(word, 14).bitwiseAND(1).alias("bit14"))


_KINDS = (("normal", 6), ("back_attack", 2), ("side_attack", 1), ("both_sides", 1), ("chocobo", 4))


@query("""WITH s AS (SELECT p_partkey AS k, p_size % 256 AS rate, p_partkey % 3 = 0 AS active FROM part), r AS (SELECT *, unnest(range(14)) AS i FROM s)
SELECT k, CAST(i AS INTEGER) AS i, CASE WHEN i < 6 THEN 'normal' WHEN i < 8 THEN 'back_attack' WHEN i = 8 THEN 'side_attack' WHEN i = 9 THEN 'both_sides' ELSE 'chocobo' END AS kind, CAST(((k * 17 + i * 1009) % 65536) % 1024 AS INTEGER) AS scene, CAST(((k * 17 + i * 1009) % 65536) // 1024 AS INTEGER) AS weight, active, CAST(rate AS INTEGER) AS rate FROM r
WHERE ((k * 17 + i * 1009) % 65536) // 1024 > 0""")
def s9_encounter_sets(spark, d):
    """Encounter sets of 32 bytes: flags, rate and fourteen packed records of five kinds, those with a weight."""
    k = F.col("k")
    records = F.concat(*[b.le((k * 17 + i * 1009) % 65536, 2) for i in range(14)])
    rows = _part(spark, d).select("k", F.unhex(F.concat(b.le(F.when(k % 3 == 0, 1).otherwise(2), 1), b.le(F.col("n") % 256, 1), records, F.lit("0000"))).alias("raw"))
    kinds = F.array(*[F.lit(kind) for kind, times in _KINDS for _ in range(times)])
    each = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.struct(i.alias("i"), F.element_at(kinds, i + 1).alias("kind"), b.u16(F.col("raw"), 2 + 2 * i).alias("packed")))
    out = rows.where(F.length("raw") == 32).select("k", b.u8(F.col("raw"), 0).bitwiseAND(1).cast("boolean").alias("active"), b.u8(F.col("raw"), 1).alias("rate"), F.explode(each).alias("r"))
    return out.select("k", "r.i", "r.kind", F.col("r.packed").bitwiseAND(1023).alias("scene"), F.shiftright("r.packed", 10).alias("weight"), "active", "rate").where("weight > 0")


@query("""WITH n AS (SELECT n_regionkey AS r, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey), bad AS (SELECT r, names, len(list_filter(names, lambda x: NOT regexp_full_match(x, '[a-zA-Z0-9_]*'))) > 0 AS bad FROM n)
SELECT CAST(r AS INTEGER) AS r, CASE WHEN bad THEN 'invalid_name' ELSE 'valid' END AS status, CAST(i AS INTEGER) AS i, CASE WHEN NOT bad THEN names[i + 1] END AS name FROM (SELECT r, bad, names, unnest(CASE WHEN bad THEN [-1] ELSE range(len(names)) END) AS i FROM bad)""")
def s10_name_lists(spark, d):
    """Name lists of 32 bytes a name with a count before them; a list with a bad length, end or letter is one error row."""
    packed = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("int").alias("r")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    field = lambda s: F.rpad(F.hex(s.cast("binary")), 64, "0")
    rows = packed.select("r", F.unhex(F.concat(b.le(F.size("x"), 2), F.array_join(F.transform("x", lambda v: field(v["n_name"])), ""))).alias("raw"))
    count = b.u16(F.col("raw"), 0)
    slot = lambda i: F.substring(F.hex("raw"), 5 + 64 * i, F.lit(64))
    names = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.regexp_extract(slot(i), "^((?:[0-9A-F]{2})*?)00", 1))
    ended = F.forall(F.sequence(F.lit(0), count - 1), lambda i: slot(i).rlike("^(?:[0-9A-F]{2})*?00"))
    text = F.transform(names, lambda h: F.decode(F.unhex(h), "US-ASCII"))
    status = F.when((count == 0) | (F.length("raw") != 2 + 32 * count), "invalid_length").when(~ended, "unterminated").when(F.exists(text, lambda t: ~t.rlike("^[a-zA-Z0-9_]*$")), "invalid_name").otherwise("valid")
    out = rows.select("r", status.alias("status"), text.alias("names"))
    listed = F.when(F.col("status") == "valid", F.col("names")).otherwise(F.array(F.lit(None).cast("string")))
    return out.select("r", "status", F.posexplode(listed).alias("i", "name")).withColumn("i", F.when(F.col("status") == "valid", F.col("i")).otherwise(-1))


@query("""WITH r AS (SELECT c_custkey AS k, 1 + c_custkey % 6 AS used FROM customer), s AS (SELECT k, used, unnest(range(12)) AS slot FROM r)
SELECT k, CAST(slot AS INTEGER) AS slot, CAST(344 + 16 * slot AS INTEGER) AS at, CAST((k * 7 + slot) % 256 AS INTEGER) AS grp, CAST(slot % 8 AS INTEGER) AS state, CAST((k + slot) % 8 AS INTEGER) AS behavior, CAST((k * 13) % 2000 - 1000 AS INTEGER) AS ax,
  CASE WHEN (k * 7 + slot) % 256 = 255 OR (k + slot) % 8 > 5 THEN 'unknown' ELSE 'record' END AS class FROM s WHERE slot < used""")
def s15_triggers(spark, d):
    """Twelve trigger slots of a section; slots with the unused pattern are left out, odd ones are unknown."""
    k = F.col("k")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (1 + F.col("c_custkey") % 6).alias("used"))
    unused = "0000" * 6 + "ff000000"

    def slot(i: int):
        made = F.concat(b.le((k * 13) % 2000 - 1000, 2), *[b.le(F.lit(i * j), 2) for j in range(1, 6)], b.le((k * 7 + i) % 256, 1), b.le(F.lit(i % 8), 1), b.le((k + i) % 8, 1), b.le(F.lit(0), 1))
        return F.when(F.col("used") > i, made).otherwise(unused)

    raw = rows.select("k", F.unhex(F.concat(F.lit("00" * 344), *[slot(i) for i in range(12)])).alias("raw"))
    at = lambda i: 344 + 16 * i
    each = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(i.alias("slot"), at(i).alias("at"), F.hex(F.substring(F.col("raw"), at(i) + 1, F.lit(16))).alias("bytes"), b.i16(F.col("raw"), at(i)).alias("ax"), b.u8(F.col("raw"), at(i) + 12).alias("grp"), b.u8(F.col("raw"), at(i) + 13).alias("state"), b.u8(F.col("raw"), at(i) + 14).alias("behavior")))
    out = raw.where(F.length("raw") == 536).select("k", F.explode(each).alias("t")).select("k", "t.*").where(F.lower("bytes") != unused)
    odd = (F.col("grp") == 255) | (F.col("behavior") > 5) | (F.col("bytes") == "00" * 16)
    return out.select("k", "slot", "at", "grp", "state", "behavior", "ax", F.when(odd, "unknown").otherwise("record").alias("class"))


@query("""WITH r AS (SELECT s_suppkey AS k, s_name AS t, s_suppkey % 5 AS kind FROM supplier) SELECT k, CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN NULL ELSE t END AS text FROM r""")
def f4_printable_text(spark, d):
    """Single-byte text of the printable range; without an end, or with another glyph, there is none."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 5).alias("kind"), "s_name")
    shifted = F.array_join(F.transform(F.split("s_name", ""), lambda c: b.le(F.ascii(c) - 32, 1)), "")
    raw = F.when(F.col("kind") == 0, shifted).when(F.col("kind") == 1, F.concat(shifted, F.lit("7fff"))).otherwise(F.concat(shifted, F.lit("ff7f")))
    return rows.select("k", b.printable(F.unhex(raw)).alias("text"))


@query("""SELECT p_partkey AS k, sha256('{"name":"' || replace(replace(p_name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '","size":' || p_size || ',"type":"' || p_type || '"}') AS digest FROM part""")
def f77_canonical_digest(spark, d):
    """SHA-256 of rows as compact JSON with sorted keys (also Z3, Z23: the identity of an input)."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.sha2(F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))), 256).alias("digest"))
