"""Edges, adjacency and graphs of faces without broadcasts on an estimate, on small inputs."""

import pytest
from pyspark.sql import functions as F

from meshlark.operators import corridor, graph, topology
from meshlark.plans import every
from meshlark.sources import tables

DATA = "/root/testdata/sf0.001"
FACE = "face long, x0 long, z0 long, h0 long, x1 long, z1 long, h1 long, x2 long, z2 long, h2 long, region int"
NAMES = "a20_region_adjacency g0_routing_arcs j11_seam_pairs j10_edge_neighbours g0_welded_graph a10_surface_totals g7_invalid_steps g1_eligible_components a19_component_stats f24_height_delta g4_corridor_legs g5_route_profiles".split()


@pytest.mark.parametrize("name", NAMES)
def test_no_join_is_broadcast_on_an_estimate(spark, name):
    plan = every.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", ["a20_region_adjacency", "g0_routing_arcs", "j11_seam_pairs"])
def test_edges_are_joined_to_nothing(spark, name):
    # the only join is that of faces with the number of their duplicates
    plan = every.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_seam_and_regions(spark):
    rows = [(0, 0, 0, 1, 4, 0, 1, 0, 4, 1, 1), (1, 4, 0, 1, 4, 4, 1, 0, 4, 1, 2), (2, 0, 4, 1, 4, 4, 1, 0, 8, 1, 2), (3, 0, 8, 1, 0, 12, 1, 0, 8, 1, 1)]
    faces = spark.createDataFrame(rows, FACE)
    got = {(r["region_a"], r["region_b"]): (r["edges"], r["length"], r["seam_pairs"]) for r in topology.adjacency(faces, 4).collect()}
    assert got == {(1, 2): (1, round(32**0.5, 6), 1)}
    assert sorted(map(tuple, topology.links(faces, 4, True).collect())) == [(1, 2)]
    seams = sorted((r["side"], r["seam"], r["face"], r["partner"]) for r in topology.edges(faces, 4).where("side IS NOT NULL").collect())
    assert seams == [("east", "paired", 1, 0), ("west", "paired", 0, 1), ("west", "unmatched", 2, None), ("west", "unmatched", 3, None), ("west", "unmatched", 3, None)]


def test_tables_that_are_read_again_are_not_broadcast(spark):
    table = graph.cut(spark.range(1000).withColumnRenamed("id", "node"))
    plan = table.join(table.toDF("node2"), F.expr("node = node2"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    few, many = graph._few(table), graph._few(table, 999)
    other = spark.range(5).withColumnRenamed("id", "node").hint("merge")
    assert "BroadcastHashJoin" in other.join(few, "node")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in other.join(many, "node")._jdf.queryExecution().executedPlan().toString()


def test_ways_are_computed_once_for_each_pair_of_faces(spark):
    rows = [(0, 0, 0, 1, 4, 0, 1, 0, 4, 1, 1), (1, 4, 0, 1, 4, 4, 1, 0, 4, 1, 2), (2, 0, 8, 1, 4, 8, 1, 0, 12, 1, 2)]
    faces = spark.createDataFrame(rows, FACE).hint("merge")
    steps = spark.range(300).selectExpr("id AS trip", "explode(array(1L, 2L)) AS seq").selectExpr("trip", "seq", "seq - 1 AS src", "seq AS dst")
    got = corridor.legs(steps, faces, 1000, 1000, "trip")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [src#" in plan and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    told = {(r["seq"], r["part"], r["face"], r["status"], r["distance"] is None, r["n"]) for r in got.groupBy("seq", "part", "face", "status", "distance").agg(F.count("*").alias("n")).collect()}
    assert told == {(1, 0, 0, "ok", False, 300), (1, 1, 1, "ok", False, 300), (2, 0, 1, "error", True, 300), (2, 1, 2, "error", True, 300)}


def test_heights_are_looked_up_once(spark):
    # the only join is that of points with the faces over them
    plan = every.QUERIES["f24_height_delta"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "SortAggregate" not in plan


def test_heights_of_the_surface_leave_code_that_is_compiled(spark):
    # the virtual machine leaves methods of more than 8,000 bytes to its interpreter
    plan = tables.faces(spark, DATA)._jdf.queryExecution().executedPlan()
    stats = getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenStringSeq(plan)
    assert stats.size() > 0 and max(stats.apply(i)._3().maxMethodCodeSize() for i in range(stats.size())) < 8000


def test_edges_of_the_seam_need_its_faces_only(spark):
    f = tables.faces(spark, DATA)
    near = topology.on_seam(f, tables.WIDTH)
    told = lambda e: sorted(map(str, e.where("side IS NOT NULL").collect()))
    assert 0 < near.count() < f.count() / 10 and told(topology.edges(near, tables.WIDTH)) == told(topology.edges(f, tables.WIDTH))
    plan = every.QUERIES["j11_seam_pairs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "5000" in plan.split("Generate explode(array(struct(slot")[1]


def test_equal_sides_are_counted_before_they_meet(spark):
    # face 0 comes five times, face 1 three times and has a side twice
    rows = [(0, 0, 0, 1, 4, 0, 1, 0, 4, 1, 1)] * 5 + [(1, 0, 0, 1, 4, 0, 1, 4, 0, 1, 2)] * 3
    faces = spark.createDataFrame(rows, FACE)
    assert [tuple(r) for r in topology.neighbours(faces).collect()] == [(0, 1, 30)]
    plan = topology.neighbours(faces)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" in plan.split("Join")[1] and every.QUERIES["j10_edge_neighbours"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_centres_come_with_the_pairs(spark):
    # the only join is that of faces with the number of their duplicates
    plan = every.QUERIES["g0_welded_graph"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
    rows = [(0, 0, 0, 1, 4, 0, 1, 0, 4, 1, 1), (1, 4, 0, 1, 4, 4, 1, 0, 4, 1, 2), (2, 4, 4, 1, 0, 4, 1, 4, 8, 1, None)]
    faces = spark.createDataFrame(rows, FACE).hint("merge")
    assert sorted(map(tuple, corridor.neighbours(faces, 1000, "region").collect())) == [(0, 1, 1, 2), (1, 2, 2, None)]
    got = corridor.eligible_components(faces, 1000, F.col("region") < 3)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 2, 32), (1, 0, 2, 32)]


def test_rounds_ask_once_and_of_what_is_written(spark, monkeypatch):
    path = spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("weight"))
    nodes = spark.range(9).withColumnRenamed("id", "node")
    asked = []
    for name in ("isEmpty", "count"):
        monkeypatch.setattr(type(nodes), name, lambda df, real=getattr(type(nodes), name): asked.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    label = graph.components(nodes, path)
    assert asked and not any("Join" in plan for plan in asked)
    asked.clear()
    far = graph.distances(path, nodes.where("node = 0"))
    assert len(asked) == 10
    assert {r["label"] for r in label.collect()} == {0} and sorted(r["distance"] for r in far.collect()) == list(range(9))


def test_legs_without_heights_carry_none(spark):
    plan = every.QUERIES["g4_corridor_legs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_h" not in plan and "h1#" not in plan.split("Join", 1)[0]
