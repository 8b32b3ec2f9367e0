"""Queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from meshlark.plans import every as catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark pages".split()
#: Queries whose rounds or recursive SQL take long even here; tests/test_operators.py has small cases of their operators.
SLOW = {"t5_region_components", "a19_component_stats", "g2_route", "g3_service_area", "g7_invalid_steps", "w8_csr_offsets", "j14_component_membership"}
SLOW |= {"v6_two_versions", "s23_save_slots", "z14_section_rehash", "k2_csr_pack", "t3_face_edges", "p5_diagnostic_filters", "a10_surface_totals", "g15_evidence_chains", "x6_ownership", "s31_manifest_cycles", "j8_transects", "g1_eligible_components"}
FAST = sorted(set(catalog.ORACLE) - SLOW)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_a_callable_with_a_name():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
