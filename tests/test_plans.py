"""Joins with the faces are not broadcast on an estimate: small tables, whose estimates are under any threshold, show it."""

import pytest

from meshlark.plans import every

DATA = "/root/testdata/sf0.001"
NAMES = ["j8_transects", "a17_route_exposure", "a2_region_terrain", "f20_containing_surface"]


@pytest.mark.parametrize("name", NAMES)
def test_no_join_is_broadcast(spark, name):
    plan = every.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
