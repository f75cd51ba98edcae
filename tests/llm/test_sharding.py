import random
from collections import defaultdict

from caseweave.llm import sharding


def brute(items, limit):
    """items: (h as 64 bits, bytes). Splits bucket by bucket."""
    out = {}

    def split(prefix, rows):
        if not rows:
            return
        if sum(b for _, b in rows) <= limit or len({h for h, _ in rows}) == 1:
            for h, _ in rows:
                out[h] = prefix or "-"
            return
        bit = 63 - len(prefix)
        split(prefix + "0", [r for r in rows if not r[0] >> bit & 1])
        split(prefix + "1", [r for r in rows if r[0] >> bit & 1])

    split("", items)
    return out


def check(spark, rows, limit, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, shard_id string, h int")
    got = sharding.shard_documents(df, limit, keep=("doc_id", "text"), **more).select("kept.*", "shard_id", "depth", "shard_bytes", "shard_docs", "oversize").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    hashed = df.select("doc_id", "text", sharding.shard_hash().alias("h")).collect()
    h = {(r.doc_id, r.text): r.h & (1 << 64) - 1 for r in hashed}
    want = brute([(h[d, t], len((t or "").encode())) for d, t in rows], limit)
    shards = defaultdict(list)
    for r in got:
        assert r.shard_id == want[h[r.doc_id, r.text]]
        shards[r.shard_id].append(r)
    for s, rs in shards.items():
        size = sum(len((r.text or "").encode()) for r in rs)
        assert {(r.shard_bytes, r.shard_docs, r.depth) for r in rs} == {(size, len(rs), 0 if s == "-" else len(s))}
        assert {r.oversize for r in rs} == {size > limit}
        assert size <= limit or len({(r.doc_id, r.text) for r in rs}) == 1
    return shards


def test_against_splitting_bucket_by_bucket(spark):
    rng = random.Random(37)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(400)] + [(None, None), (None, "a"), (None, "b" * 50), (7, "same" * 9), (7, "same" * 9), (7, "same" * 9), (1000, "x" * 900)]
    assert len(check(spark, rows, 500)) > 40
    check(spark, rows, 500, first_bits=2, more_bits=2)
    check(spark, rows, 100, first_bits=3, more_bits=5)
    assert list(check(spark, rows, 10**9)) == ["-"]


def test_empty_and_nothing_to_weigh(spark):
    assert not check(spark, [], 10)
    assert list(check(spark, [(1, None), (2, "")], 10)) == ["-"]


def test_query(spark, sf):
    df = sharding.op9_sharding(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
