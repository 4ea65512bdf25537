"""The queries of the package on the smallest tables; those with SQL give its rows."""

import os

import pytest

from scriptorium.llm import queries as llm

from .. import oracle

DATA = os.environ.get("SCRIPTORIUM_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, DATA)
    sql = llm.oracle_sql().get(name)
    if sql is None:
        assert len(set(df.columns)) == len(df.columns)
        df.collect()
    else:
        oracle.same(df, oracle.connection(DATA).sql(sql))
