import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from caseweave.llm import exact_dedup
from caseweave.llm._common import Sieve, keep_ids


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        keep = min(g, key=lambda x: x[:3])[3]
        out.append((d, keep, len(g), d == keep))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, keep_id int, full_hash string")
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, **more).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 6)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \x0b\x0c\r"), (1003, "x" * 300 + "a"), (1004, "x" * 300 + "b"), (1005, "x " * 300 + "b")]
    rows += [(None, "ab"), (None, "lone text"), (5, "again"), (5, "again"), (1006, "nb\xa0sp"), (1007, "nbsp")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, prefix=1, most_bits=1, salts=3) == brute(rows)
    assert run(spark, rows, digest="d") == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_query(spark, sf):
    got = exact_dedup.op1_exact_dedup(spark, sf)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == sorted(brute(list(docs.items())))
    for r in rows:
        assert r.text_sha256 == sha256(re.sub(r"[\x20\x09-\x0D]", "", docs[r.doc_id]).encode()).hexdigest()


def test_query_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a b"), (None, "ab"), (1, "ab"), (1, "ab"), (1, "other"), (2, None), (3, ""), (4, "lone"), (None, "lone too")] * 2
    spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, text_sha256 int").write.parquet(f"{tmp_path}/documents.parquet")
    got = exact_dedup.op1_exact_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows)
    want = [sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest() for _, t in rows]
    assert sorted(r.text_sha256 for r in got) == sorted(want)


def test_the_sieve_lets_through_what_was_put_in_and_little_else(spark):
    pairs = spark.range(4000).selectExpr("xxhash64(id) AS h")
    sieve = Sieve(pairs)
    assert sieve.bits == 32768
    every = pairs.selectExpr("h", "true AS old").unionByName(spark.range(4000).selectExpr("xxhash64(-1 - id) AS h", "false AS old"))
    got = {r.old: r.n for r in sieve.marked(every, F.col("h"), "look").filter("look").groupBy("old").agg(F.count("*").alias("n")).collect()}
    assert got[True] == 4000 and got[False] < 800
    assert Sieve(pairs.limit(0)).marked(every, F.col("h"), "look").filter("look").isEmpty()


def test_keep_ids_by_broadcast_and_by_sieve(spark):
    docs = spark.createDataFrame([(i % 50 if i % 9 else None, f"t{i}", "x") for i in range(300)], "doc_id long, text string, __x string")
    for ids in ([], [3, 4, None], list(range(0, 60, 2))):
        side = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        for keep in (True, False):
            want = sorted((tuple(r) for r in docs.collect() if (r.doc_id in ids) == keep), key=str)
            a, b = (sorted((tuple(r) for r in keep_ids(docs, side, keep, limit).collect()), key=str) for limit in (1 << 20, -1))
            assert a == b == want
