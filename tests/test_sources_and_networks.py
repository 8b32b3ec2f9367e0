"""Binary formats, scene networks, arcs and transects on small fixtures."""

import struct

import pytest
from pyspark.sql import functions as F

from meshlark.functions import sphere
from meshlark.operators import graph, network, ordered, transect, variant
from meshlark.sources import archives


def deflate(data):
    """Shortest match first, by trying every place of the ring."""
    ring, at, out, tokens, i = bytearray(4096), 4078, bytearray(), [], 0
    while i < len(data):
        best = (0, 0)
        for place in range(4096):
            trial, w, n = bytearray(ring), at, 0
            while n < 18 and i + n < len(data) and trial[(place + n) & 4095] == data[i + n]:
                trial[w] = data[i + n]
                w, n = (w + 1) & 4095, n + 1
            best = max(best, (n, -place))
        n = best[0] if best[0] >= 3 else 1
        tokens.append(bytes([data[i]]) if n == 1 else bytes([-best[1] & 255, (-best[1] >> 4 & 240) | n - 3]))
        for _ in range(n):
            ring[at] = data[i]
            at, i = (at + 1) & 4095, i + 1
    for k in range(0, len(tokens), 8):
        out.append(sum(1 << b for b, t in enumerate(tokens[k : k + 8]) if len(t) == 1))
        out += b"".join(tokens[k : k + 8])
    return bytes(out)


@pytest.mark.parametrize("text", [b"", b"a", b"abcabcabcabcabcabc", b"\0" * 40 + b"xyz" + b"\0" * 25])
def test_inflate_gives_back_what_was_packed(text):
    assert archives.inflate(deflate(text)) == text


def test_inflate_refuses_bad_members():
    for bad in (b"\xff", b"\x00\x01"):
        with pytest.raises(ValueError):
            archives.inflate(bad)
    with pytest.raises(ValueError):
        archives.inflate(deflate(b"abcd" * 10), most=39)


def archive(members):
    start = 16 + 27 * len(members) + 3600 + 2
    toc, body = b"", b""
    for name, text in members:
        toc += struct.pack("<20sIBH", name.encode(), start + len(body), 14, 0)
        body += struct.pack("<20sI", name.encode(), len(text)) + text
    return b"\0\0" + b"MAKER".ljust(10, b"\0") + struct.pack("<I", len(members)) + toc + bytes(3602) + body


def test_archives_keep_good_files_beside_bad_ones(spark):
    good = archive([("a.tex", b"one"), ("b.bin", b"")])
    overlapping = bytearray(archive([("a", b"x" * 30), ("a", b"y")]))
    struct.pack_into("<I", overlapping, 16 + 27 + 20, struct.unpack_from("<I", overlapping, 36)[0])
    rows = [("good", good), ("short", b"abc"), ("cut", good[:-2]), ("overlap", bytes(overlapping)), ("none", None)]
    got = archives.scan(spark.createDataFrame(rows, "path string, content binary"), "archive").collect()
    assert sorted((r["name"], r["size"], bytes(r["text"])) for r in got if r["error"] is None) == [("a.tex", 3, b"one"), ("b.bin", 0, b"")]
    assert sorted(r["path"] for r in got if r["error"]) == ["cut", "none", "overlap", "short"]


def test_save_slots():
    assert archives.crc16(b"123456789") == 0xD64E
    body = bytes(range(256)) * 17
    valid = bytearray(body[:4340])
    struct.pack_into("<H", valid, 0, archives.crc16(bytes(valid[4:])))
    broken = bytearray(valid)
    broken[100] ^= 1
    found = archives.slots(bytes(9) + bytes(valid) + bytes(broken) + bytes(4340) * 13)
    assert [s for *_, s in found] == ["valid", "checksum"] + ["empty"] * 13


def test_networks_against_closure(spark):
    arcs = {0: [1, 2], 1: [3], 2: [3], 3: [1], 4: [4], 5: [0]}
    rows = [(7, t, s, ds[s] if s < len(ds) else None) for t, ds in arcs.items() for s in range(3)]
    access = spark.createDataFrame(rows, "field long, tri long, slot int, dst long")
    got = {r["tri"]: (r["weak"], r["strong"]) for r in network.components(access).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 1), 4: (4, 4), 5: (0, 5)}
    reached = {r["tri"]: (r["level"], r["parent"]) for r in network.reach(access, spark.createDataFrame([(7, 0)], "field long, start long")).collect()}
    assert reached == {0: (0, None), 1: (1, 0), 2: (1, 0), 3: (2, 1)}
    gates = spark.createDataFrame([(7, 3, 8, 0), (7, 5, 9, 0)], "from_field long, from_tri long, to_field long, to_tri long")
    entries = network.transfers(access, gates, 7, 0).collect()
    assert sorted(map(tuple, entries)) == [(7, 0, 0), (8, 0, 1)]


def test_route_and_missing_route(spark):
    one = [(0, 1, 2), (1, 2, 3), (0, 2, 9), (2, 3, 4)]
    arcs = spark.createDataFrame(one + [(b, a, w) for a, b, w in one], "src long, dst long, weight long")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    assert [tuple(r) for r in graph.route(arcs, node(0), node(3)).orderBy("distance").collect()] == [(0, 0), (1, 2), (2, 5), (3, 9)]
    assert graph.route(arcs, node(0), node(8)).isEmpty()
    steps = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 3, 1), (3, 2, 3, 5)], "seq int, src long, dst long, weight long")
    assert sorted(r["seq"] for r in graph.invalid_steps(steps, arcs).collect()) == [2, 3]


def test_calls_report_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "caller int, callee int")
    got = graph.calls(edges, spark.createDataFrame([(1,)], "root int")).collect()
    assert sorted((r["callee"], r["depth"]) for r in got) == [(1, 3), (2, 1), (3, 2), (4, 3)]
    assert graph.calls(edges, spark.createDataFrame([(1,)], "root int"), most=1).count() == 1


def test_circular_span(spark):
    rows = [("wrap", 350, 370), ("wrap", 10, 20), ("one", 30, 40), ("full", 0, 360), ("tie", 0, 10), ("tie", 180, 190)]
    got = {r["k"]: tuple(r)[1:] for r in ordered.circular_span(spark.createDataFrame(rows, "k string, lo long, hi long"), "k", "lo", "hi", 360).collect()}
    assert got == {"wrap": (350, 20, 30, True), "one": (30, 40, 10, False), "full": (0, 0, 360, False), "tie": (180, 10, 190, True)}


def test_antimeridian_and_great_circle(spark):
    rows = spark.sql("SELECT array(named_struct('lon', 170D, 'lat', 0D), named_struct('lon', -170D, 'lat', 10D), named_struct('lon', -160D, 'lat', 10D)) AS p")
    parts = rows.select(sphere.split_at_antimeridian(F.col("p")).alias("s")).first()["s"]
    assert [[tuple(round(v, 9) for v in p) for p in part] for part in parts] == [[(170, 0), (180, 5)], [(-180, 5), (-170, 10), (-160, 10)]]
    c = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(sphere.samples(*c(0, 0, 90, 0), 45.0).alias("a"), sphere.samples(*c(0, 0, 180, 0), 45.0).alias("b")).first()
    assert [round(p["lon"], 9) for p in row["a"]] == [0, 45, 90]
    assert row["b"] is None


CORNERS = "face long, x0 long, z0 long, h0 long, x1 long, z1 long, h1 long, x2 long, z2 long, h2 long, terrain int, script int"


def test_transect_over_two_faces_and_a_gap(spark):
    faces = spark.createDataFrame([(1, 0, 0, 0, 10, 0, 10, 0, 10, 0, 0, 0), (2, 20, 0, 5, 30, 0, 5, 20, 10, 5, 0, 0)], CORNERS)
    seg = spark.createDataFrame([(1, 0, 2, 40, 2), (2, 50, 50, 60, 50)], "tid int, sx long, sz long, ex long, ez long")
    found = transect.traces(faces, seg, 7)
    assert sorted((r["tid"], r["face"], r["t0"], r["t1"], round(r["h0"], 9), round(r["h1"], 9)) for r in found.collect()) == [(1, 1, 0.0, 0.2, 0.0, 8.0), (1, 2, 0.5, 0.7, 5.0, 5.0)]
    assert [tuple(round(v, 9) for v in r) for r in transect.coverage(found).collect()] == [(1, 0.4, 2)]


def test_variant_buckets(spark):
    base = spark.createDataFrame([(1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 4, 0), (2, 5, 0, 0, 6, 0, 0, 5, 1, 0, 4, 0)], CORNERS)
    other = spark.createDataFrame([(1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 4, 0), (3, 0, 1, 0, 1, 0, 0, 0, 0, 0, 5, 0)], CORNERS)
    got = {r["status"]: (r["base_n"], r["other_n"], r["ambiguous"], r["winding_common"], r["attribute_common"]) for r in variant.buckets(base, other).collect()}
    assert got == {"common": (1, 2, True, 1, 1), "base_only": (1, 0, False, 0, 0)}


def test_g2_route_has_no_distance_limit(spark, monkeypatch):
    import heapq
    import random

    from meshlark.plans import travel

    r = random.Random(5)
    arcs = [(a, b, r.randint(20, 60)) for a in range(200) for b in {(a * 7 + 3) % 200, (a * 11 + 5) % 200, (a + 1) % 200} - {a}]
    known, heap = {}, [(0, 20)]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in known:
            known[a] = d
            for s, t, w in arcs:
                if s == a:
                    heapq.heappush(heap, (d + w, t))
    monkeypatch.setattr(travel, "_arcs", lambda spark, d: spark.createDataFrame(arcs, "src long, dst long, weight long"))
    way = [(x["node"], x["distance"]) for x in travel.g2_route(spark, "").orderBy("seq").collect()]
    best = min((known[x], x) for x in (26, 28))
    assert best[0] > 40 and way[0] == (20, 0) and way[-1] == best[::-1]
    assert all(known[a] == d for a, d in way) and all((a, b, d1 - d0) in arcs for (a, d0), (b, d1) in zip(way, way[1:], strict=False))


def test_s3_inflates_names_of_any_length(spark, tmp_path):
    from meshlark.plans import archives as queries

    names = [None, "", "a", "ab", "abc", "x" * 18, "0123456789" * 2, "é" + "name of some length " * 7, *["".join(chr(97 + i * i % 26) for i in range(n)) for n in (17, 19, 36, 37, 200, 2100, 4090, 4096, 4100, 9000)]]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {x["p_partkey"]: x["text"] for x in queries.s3_inflate(spark, str(tmp_path)).collect()}
    assert [got.get(i, "no row") for i in range(len(names))] == [None if x is None else x * 3 for x in names]
