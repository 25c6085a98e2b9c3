"""Every registered query with SQL gives the rows of that SQL; the others run and give rows."""

import pytest

from cutoffs import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(registry.oracle_sql())
WITHOUT = sorted(set(registry.queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_is_its_sql(spark, con, name):
    assert oracle.compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], SF, con) == ""


@pytest.mark.parametrize("name", [n for n in WITHOUT if n not in ("G10_flow_directions", "G12_height_above_drainage")])
def test_query_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
