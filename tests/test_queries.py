import pytest

from symgraph.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_and_sql(spark, sf_dir, con, name):
    assert oracle.difference(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["file", "hits", "min_depth"]
    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
