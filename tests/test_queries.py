import os

import pytest

import __spark_entry__
from codestrata.plans import registry
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLE_SQL[name]) > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
