"""Every registered query outside the optional subpackage against its oracle; those without one must run."""

import pytest

from tabulon import registry
from tests.oracle import DATA, connect, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    same(registry.QUERIES[name](spark, str(DATA)), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
