"""Projections and polygons against plain Python, ratios against fractions, versions on disk."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from meshlark.functions import binary, sphere
from meshlark.operators import tin
from meshlark.sources import sinks

PLACES = [(0.0, 0.0), (10.0, 45.0), (-170.0, -88.0), (179.0, 89.999), (33.0, 90.0), (-60.0, -90.0), (120.0, 66.0), (1.0, -1e-9)]


def solved_mollweide(lat):
    lo, hi = -math.pi / 2, math.pi / 2
    for _ in range(200):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if 2 * t + math.sin(2 * t) < math.pi * math.sin(lat) else (lo, t)
    return lo


def lagrange(values, at):
    first = max(0, min(len(values) - 4, math.floor(at) - 1))
    return sum(values[first + j] * math.prod((at - first - k) / (j - k) for k in range(4) if k != j) for j in range(4))


def test_solved_projections(spark):
    df = spark.createDataFrame(PLACES, "lon double, lat double")
    cols = [c.alias(f"{n[0]}{a}") for n in ("mollweide", "robinson") for a, c in zip("xy", sphere.project(n, F.col("lon"), F.col("lat")), strict=True)]
    for (lon, lat), got in zip(PLACES, df.select(*cols).collect(), strict=True):
        l, p = math.radians(lon), math.radians(lat)
        t = solved_mollweide(p)
        want = (2 * math.sqrt(2) / math.pi * l * math.cos(t), math.sqrt(2) * math.sin(t))
        assert got["mx"] == pytest.approx(want[0], abs=2e-5) and got["my"] == pytest.approx(want[1], abs=2e-5)
        at = min(18.0, abs(lat) / 5)
        assert got["rx"] == pytest.approx(0.8487 * l * lagrange(sphere.ROBINSON_X, at), abs=1e-9)
        assert got["ry"] == pytest.approx(math.copysign(1.3523 * lagrange(sphere.ROBINSON_Y, at), lat), abs=1e-9)


def test_polygons_and_horizon(spark):
    octant = [(0.0, 0.0), (90.0, 0.0), (0.0, 90.0)]
    bow = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]
    cases = {"ok": octant, "self_intersecting": bow, "vertex_count": octant[:2], "repeated_vertex": [*octant, octant[1]], "antipodal_edge": [(0.0, 0.0), (180.0, 0.0), (0.0, 80.0)]}
    df = spark.createDataFrame([(k, [dict(lon=a, lat=b) for a, b in v]) for k, v in cases.items()], "k string, ring array<struct<lon:double,lat:double>>")
    got = {r["k"]: r["p"] for r in df.select("k", sphere.polygon(F.col("ring"), 1.0).alias("p")).collect()}
    assert {k: p["status"] for k, p in got.items()} == {k: k for k in cases}
    assert got["ok"]["area"] == pytest.approx(math.pi / 2) and got["self_intersecting"]["area"] == 0
    seen = df.where("k = 'ok'").select(sphere.clipped_to_horizon(F.col("ring"), 180.0, 0.0).alias("c")).first()["c"]
    assert len(seen) in (0, 3, 4) and all(abs(p["lon"]) >= 90 - 1e-6 or p["lat"] >= 90 - 1e-6 for p in seen)


def test_rational_texts(spark):
    texts = ["1/3", "-4/6", "2.50", ".5", "3e2", "-1.5E-3", "1/0", "abc", "", "1e7", "+7", "0/5", "1" * 81, "--1", "1.2.3", None]
    got = [r["r"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tin.rational(F.col("t")).alias("r")).collect()]

    def want(t):
        try:
            v = Fraction(t) if t and len(t) <= 80 else None
        except (ValueError, ZeroDivisionError):
            return None
        return v if v is not None and abs(v) <= 1_000_000 else None

    for t, r in zip(texts, got, strict=True):
        v = want(t)
        assert (r is None) == (v is None), t
        if v is not None:
            assert (r["n"], r["d"]) == (v.numerator, v.denominator), t


def test_versions_are_whole_or_not_there(spark, tmp_path):
    root = str(tmp_path / "table")
    sinks.publish(spark.range(3), root)
    sinks.publish(spark.range(5), root)
    (tmp_path / "table" / "v000009-broken").mkdir()  # a version without its end mark is none
    assert sinks.current(spark, root).count() == 5 and len(sinks.versions(spark, root)) == 2
    sinks.roll_back(spark, root)
    assert sinks.current(spark, root).count() == 3
    (tmp_path / "table" / "CURRENT").unlink()
    assert sinks.current(spark, root).count() == 5


def test_map_positions_far_beyond_the_strip_come_back(spark):
    at = [(0, 0), (4999, 4000), (10, 120_000), (20, -120_000), (2500, 2_400_000)]
    rows = spark.createDataFrame(at, "x long, z long")
    lon, lat = sphere.to_geographic(F.col("x"), F.col("z"), 5000, 4000)
    both = rows.select(lon.alias("lon"), lat.alias("lat"), sphere.isometric_latitude(F.col("z"), 4000).alias("i"))
    x, z = sphere.from_geographic(F.col("lon"), F.col("lat"), 5000, 4000, F.col("i"))
    assert [tuple(r) for r in both.select(F.round(x).cast("long"), F.round(z).cast("long")).collect()] == at
    # a latitude alone stays finite at either pole
    north, south = (both.select(sphere.from_geographic(F.lit(0.0), F.lit(v), 5000, 4000)[1].alias("z")).first()["z"] for v in (90.0, -90.0))
    assert -30_000 < north < 0 and 4000 < south < 30_000


def test_operators_wrap_values_beyond_64_bits(spark):
    a, b = 9_500_000_011, 6_300_000_017
    rows = spark.createDataFrame([(0x30, a, b), (0x30, -a, b), (0x40, 2**63 - 1, 2**63 - 1), (0x41, -(2**63), 1), (0x50, a, 30), (0x50, 2**32 - 1, 31), (0x51, a, 3)], "op int, a long, b long")
    wrapped = lambda n: (n + 2**31) % 2**32 - 2**31
    want = [wrapped(n) for n in (a * b, -a * b, 2**64 - 2, -(2**63) - 1, a << 30, (2**32 - 1) << 31, a >> 3)]
    assert [r["v"] for r in rows.select(binary.applied(F.col("op"), F.col("a"), F.col("b")).alias("v")).collect()] == want
