"""Every registered query against its SQL on the smallest tables; those without SQL run and keep their schema."""

import pytest
from conftest import SMALL
from compare import assert_same

from vocalith.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    assert_same(registry.queries()[name](spark, SMALL), registry.oracles()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
