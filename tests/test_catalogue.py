import pytest

from telar.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
