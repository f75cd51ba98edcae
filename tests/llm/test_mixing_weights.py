from collections import Counter

from caseweave.llm import mixing


def slots_of(spark, sizes, weights=None, **more):
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(rows)], "doc_id long, source string")
    if weights:
        more["weights"] = spark.createDataFrame(list(weights.items()), "source string, weight double")
    return mixing.mix_sources(df, block=1, **more).collect()


def furthest(got, weights):
    """The largest deviation of a source's blocks from its weight, until the first source runs out."""
    total, end, by = sum(weights.values()), Counter(), {}
    for r in got:
        assert r.release <= r.slot < r.deadline and r.slot not in by
        by[r.slot] = r.kept.source
        end[r.kept.source] = max(end[r.kept.source], r.slot)
    had, worst = Counter(), 0.0
    for slot in range(min(end.values()) + 1):
        had[by[slot]] += 1
        worst = max(worst, *(abs(had[s] - w / total * (slot + 1)) for s, w in weights.items()))
    return worst, min(end.values())


def test_weights_hold_over_many_slots(spark):
    sizes = {"hot": 4000} | {f"s{i:02}": 421 for i in range(19)}
    worst, first = furthest(slots_of(spark, sizes), {s: n**mixing.TEMPER for s, n in sizes.items()})
    assert worst < 1 and first > 5000


def test_weights_hold_with_many_sources(spark):
    weights = {"half": 999.0} | {f"s{i:03}": 1.0 for i in range(999)}
    worst, first = furthest(slots_of(spark, {"half": 2000} | {s: 2 for s in weights if s != "half"}, weights), weights)
    assert worst < 1 and first > 1000


def test_least_share_only_for_those_that_need_it():
    assert mixing.shares_of([0.5, 0.25, 0.25], 1000) == [500, 250, 250]
    assert mixing.shares_of([0.5, 0.5, 0.0], 1001) == [500, 500, 1]
    assert mixing.shares_of([999.0] + [1.0] * 999, 4000)[0] in (2000, 2001)
    assert mixing.shares_of([0.0, 0.0], 10) == [5, 5]
