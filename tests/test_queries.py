"""Every query with SQL gives the rows that another engine gives; the others run and keep their schema."""

import decimal
from collections import Counter

import pytest
from conftest import DATA

from quotemill import catalog


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return str(value)


def counted(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    relation = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert counted(df.columns, df.collect()) == counted(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
