import os

import pytest
from against_duckdb import DATA, check

from quarterloom import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
