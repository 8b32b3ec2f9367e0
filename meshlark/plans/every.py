"""All queries: importing a module of queries adds them to the catalog."""

from meshlark.plans import archives, evidence, geometry, packs, records, relations, scripts, travel, ways  # noqa: F401
from meshlark.plans.catalog import ORACLE, QUERIES  # noqa: F401
