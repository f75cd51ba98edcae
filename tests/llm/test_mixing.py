import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseweave.llm import mixing


def test_schedule_keeps_every_window(spark):
    rng = random.Random(29)
    for weights, period in (([1], 10), ([5, 3, 2], 10), ([1, 1, 1], 100), ([rng.random() ** 3 + 1e-6 for _ in range(25)], 300), ([0.0, 1.0], 50), ([1] * 40, 8)):
        df = spark.createDataFrame([(f"s{i:02}", float(w)) for i, w in enumerate(weights)], "source string, weight double")
        rows = sorted(mixing.schedule(spark, df, period).collect(), key=lambda r: r.slot)
        q = max(period, 4 * len(weights))
        assert [r.slot for r in rows] == list(range(q))
        had = Counter()
        share = {r.source: r.share for r in rows}
        assert sum(share.values()) == q and len(share) == len(weights) and min(share.values()) >= 1
        for r in rows:
            assert r.nth == had[r.source] and r.release <= r.slot < r.deadline
            assert (r.release, r.deadline) == (r.nth * q // r.share, -(-(r.nth + 1) * q // r.share))
            had[r.source] += 1
            for s, k in share.items():
                assert abs(had[s] - k * (r.slot + 1) / q) < 1
        for i, w in enumerate(weights):
            assert abs(share[f"s{i:02}"] / q - w / sum(weights)) <= (len(weights) + 1) / q


def rows_of(spark, rows, **more):
    df = spark.createDataFrame([(d, s, "t", 1) for d, s in rows], "doc_id long, source string, text string, slot int")
    return mixing.mix_sources(df, **more).select("kept.*", "block", "release", "deadline", "slot", "place").collect()


def test_order_of_documents(spark):
    rng = random.Random(31)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(2000)] + [(None, "a"), (5, "b"), (5, "b"), (None, None)]
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("unused", 9.0), (None, 1.0)], "source string, weight double")
    got = rows_of(spark, rows, weights=weights, block=4, period=40, chunk=50)
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    by = defaultdict(dict)
    for r in got:
        by[r.slot].setdefault("of", set()).add((r.source, r.block, r.release, r.deadline))
        by[r.slot].setdefault("places", []).append(r.place)
        assert r.release <= r.slot < r.deadline
    for x in by.values():
        assert len(x["of"]) == 1 and sorted(x["places"]) == list(range(len(x["places"])))
    last, end = Counter(), {}
    for r in got:
        last[r.source] = max(last[r.source], r.block)
        end[r.source] = max(end.get(r.source, 0), r.slot)
    assert all(sorted({r.block for r in got if r.source == s}) == list(range(last[s] + 1)) for s in last)
    # a period has 40 slots: with one block each beforehand, 1 + 36 * 2/4 of a, 1 + 36 * 1/4 of b and null, 1 of c
    had = Counter()
    for slot in range(min(end.values()) + 1):
        (s, *_), = by[slot]["of"]
        had[s] += 1
        for s, share in (("a", 19), ("b", 10), (None, 10), ("c", 1)):
            assert abs(had[s] - share * (slot + 1) / 40) < 1


def test_default_weights_and_empty(spark):
    assert rows_of(spark, []) == []
    assert [(r.slot, r.place) for r in rows_of(spark, [(1, None)])] == [(0, 0)]


def test_no_python_in_the_plan(spark, sf):
    df = mixing.op7_mixing(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert df.count() == docs.count() and df.select("doc_id").distinct().count() == docs.count()
    assert df.select(F.max("slot")).first()[0] >= 0


def test_weights_that_are_refused(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    for bad in ([("a", -1.0)], [("a", float("nan"))], [("a", float("inf"))], [("a", 1.0), ("a", 2.0)], [(None, 1.0), (None, 1.0)]):
        for use in (lambda w: mixing.mix_sources(docs, w), lambda w: mixing.schedule(spark, w)):
            with pytest.raises(ValueError):
                use(spark.createDataFrame(bad, "source string, weight double"))
    none = spark.createDataFrame([("a", None)], "source string, weight double")
    assert mixing.mix_sources(docs, none).count() == 2


def test_thirds_over_many_slots():
    run = mixing.earliest_deadline_first([1 << mixing.FINE] * 3, 3 << mixing.FINE, [40_000] * 3)
    every = sorted((slot, i) for i, at in enumerate(run) for slot in at)
    had = [0, 0, 0]
    for slot, i in every:
        had[i] += 1
        assert max(abs(n - (slot + 1) / 3) for n in had) < 1
    assert len(every) == 120_000 and mixing.shares_of([1.0] * 3, 1 << mixing.FINE) == [22906492246, 22906492245, 22906492245]


def test_larger_blocks_where_there_would_be_too_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    got = rows_of(spark, [(i, "a" if i % 3 else "b") for i in range(1000)], block=2)
    assert max(Counter((r.source, r.block) for r in got).values()) == 20 and len({(r.slot, r.place) for r in got}) == 1000


@pytest.mark.parametrize(("parts", "block"), [(1, 3), (4, 3), (9, 2), (60, 1)])
def test_in_order(spark, parts, block):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c", None]), f"t{i % 700}", i) for i in range(1500)]
    rows += [(None, "a", f"n{i}", i) for i in range(200)] + [(7, "b", "same", 1)] * 30 + [(None, None, None, 2)] * 5 + [(-1, "only", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int").repartition(5)
    tie = F.xxhash64("text")
    want = mixing.mix_sources(docs, keep=tuple(docs.columns), block=block, chunk=50, tie=tie).orderBy("slot", "place").select("kept.*").collect()
    df = mixing.mix_in_order(docs, block=block, chunk=50, tie=tie, parts=parts)
    got = df.withColumn("part_no", F.spark_partition_id()).collect()
    assert df.columns == docs.columns and Counter(map(tuple, want)) == Counter(tuple(r)[:4] for r in got) and len(got) == len(rows)
    assert [r.part_no for r in got] == sorted(r.part_no for r in got)
    # repeats that stand across a part's end stay together; all others are in their place
    repeated = {k for k, n in Counter(map(tuple, want)).items() if n > 1}
    if parts == 1:
        assert list(map(tuple, want)) == [tuple(r)[:4] for r in got]
    assert [tuple(r) for r in want if tuple(r) not in repeated] == [tuple(r)[:4] for r in got if tuple(r)[:4] not in repeated]
    n = Counter(r.part_no for r in got)
    assert max(n.values()) <= len(rows) / parts + 40 * block + 30


def test_in_order_moves_whole_rows_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    df = mixing.mix_in_order(docs, tie=F.xxhash64("text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "Python" not in plan and "Arrow" not in plan
    assert mixing.mix_in_order(docs.limit(0)).collect() == []
