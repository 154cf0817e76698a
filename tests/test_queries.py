"""Every registered query of the library against its SQL on the small tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from quillforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (Decimal, float)) and not isinstance(v, bool):
        return round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, result.fetchall())
    else:
        assert got
