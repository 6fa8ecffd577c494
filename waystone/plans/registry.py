"""All queries of the library's own operators and their SQL. Plans register here under the operators' names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waystone.sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views; the SQL may name base tables and views."""

    def add(f: Callable[[Views], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waystone.operators.search import goal_candidates

    v = Views(spark, sf_dir)
    from pyspark.sql import functions as F

    wide = v.requests.withColumns({"km": F.lit(600.0), "tol": F.lit(300.0)})
    return goal_candidates(wide, v.stations, v.events_pub, as_of="1996-01-01", sector=None)


from waystone.plans import columns, extraction, feeds, places, reports, streams  # noqa: E402, F401
