"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
import check
from tradewind.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = check.connect(SF)
    yield con
    con.close()


def test_every_query_has_sql():
    queries, sql = catalog.load_all()
    assert set(queries) == set(sql)
    assert set(queries) <= set(entry_point.queries()) and set(sql) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.load_all()[1]))
def test_query_equals_its_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    got = check.rows_of(df.columns, df.collect())
    cur = duck.execute(entry_point.oracle_sql()[name])
    assert got == check.rows_of([c[0] for c in cur.description], cur.fetchall())
