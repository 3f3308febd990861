"""Every registered query of the engine against its SQL."""

import oracle
import pytest

from docloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert oracle.from_spark(QUERIES[name](spark, sf)) == oracle.from_sql(SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and rows[0].doc_id == 0 and rows[1].score == 0.334456
    assert set(e.oracle_sql()) <= set(e.queries())
