"""Queries over binary columns made of the tables, decoded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.plans.catalog import query
from meshlark.sources import archives
from meshlark.sources.tables import table


#: Bytes of the longest reference.
_LONGEST = 18


def _le(value, size: int):
    """A whole number's bytes, lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0")) for i in range(size)])


@query("""SELECT p_partkey, p_name || p_name || p_name AS text FROM part""")
def s3_inflate(spark, d):
    """Names told three times, as members with back references, inflated."""
    name = F.encode("p_name", "UTF-8")
    n = F.octet_length("p_name")
    # eight bytes, then the rest, eight to a flag byte
    at = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(8))).otherwise(F.array().cast("array<int>"))
    rest = F.transform(at, lambda i: F.concat(F.unhex(F.lit("FF")), F.rpad(F.substring(name, i, F.lit(8)), 8, F.unhex(F.lit("20")))))
    literal = F.aggregate(rest, F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    padded = (F.ceil(n / 8) * 8).cast("int")
    # then the name twice by reference: first to the literals, then to the copy before, which is nearer;
    # a name longer than a reference takes several of like length, one too short for any, or longer than the ring, literals
    parts = F.greatest(F.lit(1), F.ceil(n / _LONGEST)).cast("int")
    cut = lambda i: F.floor(n * i / parts).cast("int")
    told = F.transform(F.sequence(F.lit(0), 2 * parts - 1), lambda i: _reference((archives.START + F.when(i < parts, 0).otherwise(padded) + cut(i % parts)) % archives.RING, cut(i % parts + 1) - cut(i % parts)))
    grouped = F.transform(F.sequence(F.lit(1), 2 * parts, F.lit(8)), lambda i: F.concat(F.unhex(F.lit("00")), F.aggregate(F.slice(told, i, F.lit(8)), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))))
    reference = F.aggregate(grouped, F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    refers = (n >= archives.SHORTEST) & (padded <= archives.RING)
    rows = table(spark, d, "part").select("p_partkey", n.alias("n"), padded.alias("padded"), refers.alias("refers"), F.when(refers, F.concat(literal, reference)).otherwise(F.concat(literal, literal, literal)).alias("member"))
    rows = rows.select("p_partkey", "n", "padded", "refers", archives.inflated(F.col("member"))["text"].alias("t"))
    # literals are padded each, references only once
    places = F.expr("CASE WHEN refers THEN array(1, padded + 1, padded + n + 1) ELSE array(1, padded + 1, 2 * padded + 1) END")
    whole = F.aggregate(F.transform(places, lambda i: F.substring(F.col("t"), i, F.col("n"))), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    return rows.select("p_partkey", F.decode(whole, "UTF-8").alias("text"))


def _reference(place, length):
    return F.concat(_le(place.bitwiseAND(255), 1), _le(F.shiftright(place, 4).bitwiseAND(240) + length - archives.SHORTEST, 1))


@query("""SELECT p_partkey // 40 AS field, CAST(p_partkey % 40 AS INTEGER) AS tri, CAST(p_size * 9 - 200 AS INTEGER) AS x0, CAST(p_partkey % 30000 - 15000 AS INTEGER) AS h2, coalesce(CASE WHEN p_partkey % 3 > 0 THEN CAST((p_partkey * 7) % 40 AS INTEGER) END, -1) AS second FROM part""")
def s13_scene_meshes(spark, d):
    """Scene meshes written as binary sections and scanned."""
    k = F.col("p_partkey")
    wrap16 = lambda v: _le(v.bitwiseAND(65535), 2)
    zero = _le(F.lit(0), 2)
    corners = F.concat(wrap16(F.col("p_size") * 9 - 200), *[zero] * 9, wrap16(k % 30000 - 15000), zero)
    access = F.concat(_le(F.lit(archives.ABSENT), 2), F.when(k % 3 > 0, _le((k * 7) % 40, 2)).otherwise(_le(F.lit(archives.ABSENT), 2)), _le(F.lit(archives.ABSENT), 2))
    rows = table(spark, d, "part").groupBy(F.floor(k / 40).alias("field")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", corners.alias("c"), access.alias("a")))).alias("t"))
    joined = lambda part: F.aggregate("t", F.unhex(F.lit("")), lambda s, x: F.concat(s, x[part]))
    files = rows.select(F.col("field").cast("string").alias("path"), F.concat(_le(F.size("t"), 4), joined("c"), joined("a")).alias("content"))
    found = archives.scan(files, "mesh").where("error IS NULL")
    return found.select(F.col("path").cast("long").alias("field"), "tri", F.col("corners")[0].alias("x0"), F.col("corners")[8].alias("h2"), F.coalesce(F.col("access")[1], F.lit(-1)).alias("second"))


@query("SELECT item_id, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM benchmark WHERE text IS NOT NULL")
def s2_fingerprint(spark, d):
    """Size and digest of every file."""
    files = table(spark, d, "benchmark").where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return archives.fingerprint(files).select(F.col("path").cast("long").alias("item_id"), "size", "sha256")


@query("SELECT 0 AS lost, count(*) AS extra FROM nation WHERE n_regionkey = 2")
def k7_read_back(spark, d):
    """A table with some rows twice against what was meant."""
    n = table(spark, d, "nation")
    found = archives.verified(n.union(n.where("n_regionkey = 2")), n)
    return found.agg(F.count_if(F.col("status") == "lost").alias("lost"), F.count_if(F.col("status") == "extra").alias("extra"))
