"""Every query of the training operators that SQL can state too, or whose invariants it can, on the smallest tables."""

from __future__ import annotations

import pytest

pytest.importorskip("codeloom.llm")

from codeloom.llm import queries  # noqa: E402
from tests import oracle  # noqa: E402

R = queries.collect()


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.duck(tiny)


@pytest.mark.parametrize("name", sorted(R.sql))
def test_query_equals_sql(spark, tiny, con, name):
    got = oracle.rows_of_df(R.queries[name](spark, tiny))
    assert got == oracle.rows_of_sql(con, R.sql[name])


@pytest.mark.parametrize("name", sorted(set(R.queries) - set(R.sql)))
def test_query_runs(spark, tiny, name):
    df = R.queries[name](spark, tiny)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()
