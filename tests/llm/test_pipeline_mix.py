import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from caseweave.llm import mixing
from tests.llm.test_pipeline import ITEM, WORDS, write


def test_the_mix_is_in_the_last_stage(spark, tmp_path):
    rng = random.Random(47)
    rows = []
    for i in range(1500):
        lang = rng.choice(["en", "de"])
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(4)}"
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(99)) for _ in range(40)), lang, source))
    write(spark, tmp_path, rows, [(1, ITEM)])
    cp.run(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    got = out.collect()
    want = mixing.mix_sources(out.select("doc_id", "source", "text"), tie=F.xxhash64("text")).select("kept.doc_id", "slot", "place").collect()
    assert {(r.doc_id, r.mix_slot, r.mix_place) for r in got} == {tuple(r) for r in want} and len(got) == len(want) > 1000
    # up to the slot at which the first source runs out, sources have their weights
    n, end = Counter(r.source for r in got), {}
    for r in got:
        end[r.source] = max(end.get(r.source, 0), r.mix_slot)
    first, total = min(end.values()), sum(x**mixing.TEMPER for x in n.values())
    had = Counter(s for s, _ in {(r.source, r.mix_slot) for r in got if r.mix_slot <= first})
    assert len(n) == 5 and first > 30
    assert all(abs(had[s] - n[s] ** mixing.TEMPER / total * (first + 1)) < 1.5 for s in n)
    # written in that order
    for file in (tmp_path / "out").glob("*.parquet"):
        places = [(r.shard_id, r.mix_slot, r.mix_place) for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert places == sorted(places)


def test_sharding_places_repeated_and_null_ids_and_moves_whole_rows_once(spark, tmp_path):
    rows = [(i % 40, f"t{i % 90} " * 20, "en", "ab"[i % 2]) for i in range(300)] + [(None, f"n{i % 7}", "en", None) for i in range(30)] + [(None, None, None, "a")] * 3
    docs = write(spark, tmp_path, rows, [(1, ITEM)])
    df = cp.sharded(spark, docs, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(shard_id") == 1
    got = df.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got) == Counter(rows)
    want = mixing.mix_sources(docs, keep=("doc_id", "text", "source"), tie=F.xxhash64("text")).select("kept.*", "slot", "place").collect()
    assert Counter((r.doc_id, r.text, r.source, r.mix_slot, r.mix_place) for r in got) == Counter(map(tuple, want))


def test_a_run_goes_on_where_it_was_lost(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(WORDS["en"][(i * j) % 13] + str(j) for j in range(60)), "en", "a") for i in range(60)]
    write(spark, tmp_path, rows, [(1, ITEM)])
    name = f"test-{random.random()}"
    calls = []

    def counted(k, stage, lost):
        def run(*args):
            calls.append(k)
            if k == lost:
                raise RuntimeError("the driver is lost")
            return stage(*args)

        return run

    stages = cp.STAGES
    monkeypatch.setattr(cp, "STAGES", [(n, counted(k, f, 2)) for k, (n, f) in enumerate(stages)])
    try:
        cp.run(spark, str(tmp_path), name)
    except RuntimeError:
        pass
    monkeypatch.setattr(cp, "STAGES", [(n, counted(k, f, None)) for k, (n, f) in enumerate(stages)])
    got = cp.run(spark, str(tmp_path), name)
    assert calls == [0, 1, 2, 2, 3, 4] and got.count() > 0
    folder = cp.shared_folder(spark)
    assert [cp._exists(spark, f"{folder}/pipeline-{name}/{k}-{n}") for k, (n, _) in enumerate(stages)] == [False, False, False, True, False]
