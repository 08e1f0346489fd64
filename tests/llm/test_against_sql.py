"""Each query with SQL gives the SQL's rows."""

import pytest

from swardshift.llm import queries
from verification import compare as comparer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name, monkeypatch):
    monkeypatch.setattr(comparer, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(comparer, "ORACLES", queries.ORACLES)
    ok, note = comparer.compare(name, spark, comparer.connect(SF), SF)
    assert ok, note
