"""Operators on small inputs, against values worked out by hand or by plain Python."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from meshlark.functions import search, sphere
from meshlark.operators import cfg, graph, multiset, ordered, tin, transect

FACE = "face long, x0 long, z0 long, h0 long, x1 long, z1 long, h1 long, x2 long, z2 long, h2 long"


def test_flat_wall_and_collinear(spark):
    faces = spark.createDataFrame([(0, 0, 0, 7, 2, 0, 7, 0, 2, 7), (1, 0, 0, -738, 0, 0, 4086, 0, 2, 0), (2, 0, 0, 0, 1, 1, 1, 2, 2, 2)], FACE)
    got = {r["face"]: r for r in tin.slope_aspect(tin.metrics(faces)).collect()}
    assert (got[0]["area2"], got[0]["slope"], got[0]["aspect"]) == (4, 0.0, None)
    assert got[1]["zero_xz"] and not got[1]["degenerate_3d"] and got[1]["slope"] is None
    assert got[2]["degenerate_3d"]


def test_exact_height_at_a_third(spark):
    faces = spark.createDataFrame([(0, 0, 0, 0, 4, 0, 4, 0, 4, 8)], FACE)
    points = spark.createDataFrame([(1, 1, 1, 3), (2, 12, 0, 3), (3, 13, 0, 3)], "qid long, px long, pz long, q long")
    got = {r["qid"]: (r["kind"], Fraction(r["low_n"], r["low_d"])) for r in tin.surfaces_at(faces, points).collect()}
    assert got == {1: ("inside", Fraction(1)), 2: ("boundary", Fraction(4))}


def test_walls_have_an_interval_of_heights(spark):
    faces = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 9, 0, 3, 3), (2, 0, 0, 1, 3, 0, 4, 6, 0, 7), (3, 0, 0, 5, 0, 0, 5, 0, 0, 8), (4, 0, 0, 0, 100_000, 0, 0, 0, 100_000, 0)], FACE)
    points = spark.createDataFrame([(1, 0, 1, 1), (2, 4, 0, 1), (3, 0, 0, 1), (4, 1, 1, 1)], "qid long, px long, pz long, q long")
    rows = tin.surfaces_at(faces, points).where("face <> 4").collect()
    got = {(r["qid"], r["face"]): (r["kind"], Fraction(r["low_n"], r["low_d"]), Fraction(r["high_n"], r["high_d"])) for r in rows}
    assert got == {
        (1, 1): ("vertical", 1, 7), (2, 2): ("degenerate", 5, 5), (3, 1): ("vertical", 0, 9), (3, 2): ("degenerate", 1, 1), (3, 3): ("degenerate", 5, 8),
    }
    line = spark.createDataFrame([(1, -2, 1, 2, 1), (2, 0, -1, 0, 5)], "tid long, sx long, sz long, ex long, ez long")
    cut = {(r["tid"], r["face"]): (r["kind"], round(r["t0"], 9), round(r["t1"], 9), r["h0"], r["h1"]) for r in transect.traces(faces, line, 10).where("face = 1").collect()}
    assert cut[1, 1] == ("vertical", 0.5, 0.5, 1.0, 7.0) and cut[2, 1] == ("vertical", round(1 / 6, 9), round(4 / 6, 9), 0.0, 9.0)


def test_weighted_paths(spark):
    arcs = [(0, 1, 2), (1, 2, 3), (0, 2, 9), (2, 3, 4)]
    arcs = spark.createDataFrame(arcs + [(b, a, w) for a, b, w in arcs], "src long, dst long, weight long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["distance"] for r in graph.distances(arcs, start).collect()} == {0: 0, 1: 2, 2: 5, 3: 9}
    assert {r["node"] for r in graph.distances(arcs, start, 4).collect()} == {0, 1}


def test_components_and_levels(spark):
    nodes = spark.range(7).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(5, 3), (3, 1), (2, 6)], "src long, dst long")
    assert dict(graph.components(nodes, links).collect()) == {0: 0, 1: 1, 3: 1, 5: 1, 2: 2, 6: 2, 4: 4}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "src long, dst long")
    assert {r["label"] for r in graph.components(spark.range(61).withColumnRenamed("id", "node"), path).collect()} == {0}
    arcs = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 2, 3), (2, 0, 3), (3, 0, 0)], "src long, slot int, dst long")
    assert {r["node"]: (r["level"], list(r["path"])) for r in graph.levels(arcs, 0).collect()} == {0: (0, []), 1: (1, [0]), 2: (1, [1]), 3: (2, [0, 2])}


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0, 2), ("a", 2, 5), ("a", 7, 9)], "k string, lo long, hi long")
    assert sorted(map(tuple, ordered.merged(rows, "k").select("lo", "hi").collect())) == [(0, 5), (7, 9)]
    assert sorted(map(tuple, ordered.gaps(rows, "k", F.lit(-1).cast("long"), F.lit(10).cast("long")).select("lo", "hi").collect())) == [(-1, 0), (5, 7), (9, 10)]


def test_versions_keep_missing_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k long, v string")
    assert {r["k"]: (r["status"], r["fields"]) for r in multiset.versions(a, b, "k", ["v"]).collect()} == {1: ("missing", ""), 2: ("conflict", "v"), 3: ("unchanged", ""), 4: ("added", "")}
    assert dict(multiset.upserted(a, b, "k", ["v"]).collect()) == {1: "x", 2: "z", 3: None, 4: "n"}


def test_near_names_and_marks(spark):
    names = spark.createDataFrame([("Café  ",), ("cafe",), ("caffe",), ("cfae",)], "n string")
    got = {r["n"]: r["rank"] for r in search.ranked(names, "cafe", "n").collect()}
    assert got == {"Café  ": 0, "cafe": 0, "caffe": 4}


def test_projection_poles_and_centre(spark):
    p = spark.createDataFrame([(0.0, 0.0), (0.0, 90.0)], "lon double, lat double")
    for name in sphere.PROJECTIONS:
        x, y = sphere.project(name, F.col("lon"), F.col("lat"))
        got = p.select(x.alias("x"), y.alias("y")).collect()
        assert abs(got[0]["x"]) < 1e-12 and abs(got[0]["y"]) < 1e-12
        assert abs(got[1]["x"]) < 1e-6 and got[1]["y"] > 0.5


def _dependence(root, succ):
    """By removal of nodes: n depends on b if some successor always meets n, and b does not."""
    nodes = set()

    def reach(a, without=None):
        seen, stack = set(), [a] if a != without else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [s for s in succ[x] if s != without]
        return seen

    nodes = reach(root)
    ends = {n for n in nodes if not succ[n]}
    always = lambda a, n: a == n or not (reach(a, n) & ends)
    return sorted((b, n, n not in reach(root, b)) for b in nodes if len(set(succ[b])) > 1 for n in nodes if n != b and any(always(s, n) for s in succ[b]) and not always(b, n))


def test_control_dependence_against_removal(spark):
    random.seed(5)
    for _ in range(300):
        n = random.randint(2, 9)
        succ = {i: sorted(random.sample(range(i + 1, n), min(n - i - 1, random.choice([0, 1, 2])))) for i in range(n)}
        status, got = cfg.analyse(0, succ)
        assert status == "ok" and got == _dependence(0, succ)
    assert cfg.analyse(0, {0: [1], 1: [0]})[0] == "cycle"
    rows = [(32, 32, 38), (32, 32, 43), (32, 38, 46), (32, 43, 46), (32, 46, 49), (32, 49, None)]
    out = cfg.control_dependence(spark.createDataFrame(rows, "root long, node long, succ long")).collect()
    assert sorted((r["branch"], r["dependent"], r["strong"]) for r in out) == [(32, 38, True), (32, 43, True)]
