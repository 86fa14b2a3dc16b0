"""Every registered query runs on the smallest tables; what it returns is held against SQL elsewhere."""

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


def names():
    from touchline.catalog import load
    from touchline.catalog.base import QUERIES

    load()
    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_runs(spark, name):
    rows = driver.queries()[name](spark, SF)
    assert rows.columns and len(set(rows.columns)) == len(rows.columns)
    rows.write.format("noop").mode("overwrite").save()
