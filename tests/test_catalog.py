"""Every registered query equals its SQL twin, at the smallest scale."""

import os
import sys

import pytest

import __spark_entry__ as driver
from glycoflow import catalog

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="module")
def duck():
    from compare import duck

    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    from compare import difference

    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    result = duck.execute(catalog.oracle_sql()[name])
    assert difference(rows, df.columns, result.fetchall(), [d[0] for d in result.description]) is None


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
