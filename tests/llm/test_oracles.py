import os

import duckdb
import pytest

from caseweave.llm import registry


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, cur.fetchall()))
