"""Every registered query on sf0.001: its rows equal those of its DuckDB twin, value by value."""

import os
import sys

import duckdb
import pytest

from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import canon, same  # noqa: E402

TABLES = ["documents", "labels", "embeddings", "events", "pages", "nation", "customer", "conversations", "benchmark", "supplier", "part"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    import __spark_entry__ as e
    return sorted(e.queries())


@pytest.mark.parametrize("name", _names())
def test_query_equals_twin(spark, duck, name):
    import __spark_entry__ as e
    found = e.queries()[name](spark, SF)
    sql = e.oracle_sql().get(name)
    if sql is None:
        assert found.count() > 0
        return
    columns, _, rows = canon(found.toPandas())
    want_columns, _, want = canon(duck.sql(sql).df())
    assert columns == want_columns and len(rows) == len(want)
    equal, differences = same(rows, want)
    assert equal, differences
