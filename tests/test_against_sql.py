"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import pytest

from verification import load_all
from verification.compare import compare, connect
from verification.registry import ORACLES, QUERIES

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    ok, note = compare(name, spark, con, SF)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
