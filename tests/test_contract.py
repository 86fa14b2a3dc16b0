import __spark_entry__ as driver


def test_every_oracle_belongs_to_a_query():
    queries, oracles = driver.queries(), driver.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150


def test_flagship_has_macro_rows(spark):
    rows = driver.entry(spark).where("alias = 'macro'").collect()
    assert {r["scope"] for r in rows} == {"m0", "m1", "change"}
