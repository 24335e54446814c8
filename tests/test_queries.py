"""Every query that has SQL gives the SQL's rows."""

import pytest

import compare
from gleaner import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    got = Q.queries()[name](spark, SF).toPandas()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert len(got) and not got.isna().all(axis=None)
        return
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canon(got) == compare.canon(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
