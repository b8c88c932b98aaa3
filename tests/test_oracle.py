"""Every query with oracle SQL matches DuckDB on the smallest scale factor."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import duck, normalise

SF = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as e
    return sorted(e.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as e
    got = e.queries()[name](spark, SF).toPandas()
    want = con.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert normalise(got) == normalise(want)


def test_every_query_has_a_callable():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["Occupation_Name", "avg_rating", "rating_count", "user_count"]
    assert 0 < df.count() <= 10
