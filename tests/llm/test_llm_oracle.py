"""The registered queries with SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from reelsight.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(
        map(str, want.select(*columns).fetchall()))
