"""Every query beside its SQL, on two sizes of the shared tables."""

import math
import os

import duckdb
import pytest

from caseweave.plans import registry

ROOT = "/root/testdata"
ONLY = [x for x in os.environ.get("ONLY", "").split(",") if x]
NAMES = [n for n in registry.ORACLES if not ONLY or n in ONLY]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def both(spark, name, sf):
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    assert {c[0]: kinds[str(c[1])] for c in cur.description} == dict(got.dtypes)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    return rows, want


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    rows, want = both(spark, name, f"{ROOT}/{os.environ.get('SF', 'sf0.001')}")
    assert len(rows) == len(want)
    assert want or "SF" not in os.environ
    for a, b in zip(rows, want):
        assert a == b
