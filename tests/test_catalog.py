import pytest

import __spark_entry__
from corvane.plans import catalog

from .duck import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
