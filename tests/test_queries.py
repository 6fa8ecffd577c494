"""Every registered query of the library against its SQL in DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from waystone.plans.registry import ORACLE_SQL, QUERIES
from waystone.sources.views import BASE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def bag(table):
    names = sorted(table.column_names)
    return names, Counter(zip(*[map(plain, table[n].to_pylist()) for n in names], strict=True))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_equals_sql(spark, duck, name):
    got, want = bag(QUERIES[name](spark, FOLDER).toArrow()), bag(duck.sql(ORACLE_SQL[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry_without_training_data(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
