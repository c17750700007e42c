"""Every query with a SQL twin gives the same rows as DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module
from check_twins import canonical, connect

DATA = "/root/testdata/sf0.001"
TWINS = entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["doc_id", "rank", "phrase", "score"]


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    mine = canonical(entry_module.queries()[name](spark, DATA).toPandas())
    other = canonical(duck.execute(TWINS[name]).df())
    assert mine[0] == other[0]
    assert mine[1] == other[1]
