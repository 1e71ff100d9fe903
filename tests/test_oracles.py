"""Every registered query against its SQL twin on the given tables."""

from __future__ import annotations

import pytest
from conftest import SF_DIR
from oracle import compare, connect

from doclake.plans.oracles import all_oracles
from doclake.plans.queries import all_queries

SQL = all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        df.write.format("noop").mode("overwrite").save()
        assert not df.isEmpty()


def test_every_twin_has_a_query():
    assert set(SQL) <= set(all_queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "kind", "body"]
    assert set(e.oracle_sql()) <= set(e.queries())
