"""Every query of the catalogue runs, and gives the rows of its SQL where it has one."""

import pytest

from oracle import connect, rows_of, rows_of_sql
from skein.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows_of(df)
    if name in catalogue.ORACLE_SQL:
        columns, expected = rows_of_sql(con, catalogue.ORACLE_SQL[name])
        assert columns == sorted(df.columns)
        assert got == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
