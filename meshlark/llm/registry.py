"""The queries of the text-preparation operators, with the SQL that checks them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshlark.llm import _store
from meshlark.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(q.SQL)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _store.ship(spark)
        return f(spark, sf_dir)

    query.__doc__ = f.__doc__
    return query


for _name in dir(q):
    if _name.startswith("op") and _name[2].isdigit():
        QUERIES[_name] = _shipped(getattr(q, _name))
