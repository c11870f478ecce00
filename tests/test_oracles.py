"""Every registered query against DuckDB on the smallest tables."""

import comparing
import pytest

from weftframe.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return comparing.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_and_types_as_duckdb(spark, con, small, name):
    df = QUERIES[name](spark, small)
    assert comparing.type_gaps(con, ORACLES[name], df) == {}
    assert comparing.difference(con, ORACLES[name], df) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry_module

    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
