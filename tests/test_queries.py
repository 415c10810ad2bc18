"""Every registered query against its SQL over whole tables (layer 1)."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, difference

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    frame = QUERIES[name](spark, small)
    if name in ORACLES:
        assert difference(frame, con, ORACLES[name]) == ""
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
