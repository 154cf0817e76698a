import os

import duckdb
import pytest

from quillforge.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    result = con.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    want = result.df()[columns].astype(str)
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df.values.tolist()))
    assert rows(got.toPandas()[columns].astype(str)) == rows(want)
