"""The registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_point
from checks.compare import compare, connect
from checks.oracles import ORACLES
from checks.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(entry_point.queries())
    assert set(REGISTRY) <= set(entry_point.oracle_sql())


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.count() > 0 and "overall_score" in rows.columns


@pytest.mark.parametrize("name", sorted(set(REGISTRY) & set(ORACLES)))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note
