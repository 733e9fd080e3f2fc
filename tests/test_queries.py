"""Every query against its SQL on the smallest tables; the others must give rows."""

import __spark_entry__ as entry_module
import compare
import pytest

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["source_state", "destination_state", "count", "probability"]
    assert df.count() > 0
