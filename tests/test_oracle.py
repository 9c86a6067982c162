"""Every SQL-checked query against its DuckDB oracle on the smallest test tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as ent
    return sorted(ent.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import oracle_check
    return oracle_check.duck(SF)


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import oracle_check
    import __spark_entry__ as ent
    ok, msg, _ = oracle_check.check(spark, duck, name, SF, ent.queries(), ent.oracle_sql())
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.columns == ["customer_id", "rank", "article_id", "score"]
    assert df.count() > 0
