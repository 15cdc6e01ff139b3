"""Every named query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from codeloom.plans import catalog
from tests import oracle

CORE = catalog.collect()


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.duck(tiny)


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_query_equals_sql(spark, tiny, con, name):
    got = oracle.rows_of_df(CORE.queries[name](spark, tiny))
    assert got == oracle.rows_of_sql(con, CORE.sql[name])


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_query_runs(spark, tiny, name):
    df = CORE.queries[name](spark, tiny)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
