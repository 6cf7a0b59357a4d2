"""Every reference query against DuckDB over the smallest tables."""

import pytest

import __spark_entry__ as entry
from newsloom.plans import queries as plans
from tests.compare import rows
from tests.conftest import DATA


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, f"{DATA}/sf0.001")
    told = duck.execute(plans.SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, told.fetchall())
