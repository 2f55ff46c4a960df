"""Every registered query runs, and agrees with its SQL on the smallest tables."""

import os

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        result = compare(df, con, ORACLES[name])
        assert result.startswith("ok") and "types" not in result, result
    else:
        assert df.count() >= 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)
