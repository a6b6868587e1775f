"""Every query with SQL gives the rows of its SQL, at the smallest size."""

import pytest
from conftest import SMALL, rows

from lontar.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    index = {c: i for i, c in enumerate(want.columns)}
    assert rows(df.collect(), columns) == rows(({c: r[i] for c, i in index.items()} for r in want.fetchall()), columns)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
    spark.catalog.clearCache()
