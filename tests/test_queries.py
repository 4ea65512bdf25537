"""Every core query with SQL gives the rows of its SQL; every other one runs."""

import os

import pytest

from scriptorium.plans import catalog

from . import oracle

DATA = os.environ.get("SCRIPTORIUM_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(DATA)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(set(df.columns)) == len(df.columns)
        df.collect()
    else:
        oracle.same(df, con.sql(sql))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
