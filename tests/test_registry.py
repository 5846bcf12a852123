import pytest

import __spark_entry__ as e
from faultloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 60


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert e.entry(spark).count() > 0
