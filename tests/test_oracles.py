"""Every named query against its SQL definition, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_definition_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES and not os.environ.get("ALL_QUERIES"):
        pytest.skip("rows only; the operators behind it have tests of their own")
    ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
