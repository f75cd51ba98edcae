import random

import corpus_pipeline as cp
from caseweave.llm import decontaminate, language
from tests.llm import test_decontaminate, test_simhash

WORDS = {
    "en": "the cat sat on mat and then it ran away from that big house".split(),
    "de": "der hund und die katze schlafen nicht im kleinen haus am see".split(),
}


def corpus(rng):
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(30, 200))), lang, rng.choice("aab")))
    rows += [(200 + i, rows[i][1], rows[i][2], "c") for i in range(20)]  # copies
    rows += [(300, None, "en", "a"), (301, "", "en", "a"), (302, "12 34 !!", "en", None), (303, rows[5][1] + " " + ITEM, "en", "b")]
    rows += [rows[7], rows[8]]
    return rows


ITEM = "one two three four five six seven eight nine ten eleven twelve"
SCHEMA = "doc_id long, text string, lang string, source string"


def write(spark, folder, rows, items):
    extra = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2.0) for r in rows], SCHEMA + ", n_chars long, shard_id string, component_id int, score double")
    extra.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(random.Random(41))
    docs = write(spark, tmp_path, rows, [(1, ITEM), (2, "zz yy")])
    columns = docs.columns
    stages = dict(cp.STAGES)

    one = stages["language_id"](spark, docs, str(tmp_path))
    model = language.fit(docs.filter(~language.held_out()))
    lang, score = model.predict([r[1] or "" for r in rows])
    assert one.columns == columns
    kept = [r for r, g, s in zip(rows, lang, score) if g != "und" and s >= cp.LEAST_SCORE]
    assert key(one.select(*columns[:4]).collect()) == key(kept)
    assert {r[0] for r in rows} - {r[0] for r in kept} == {300, 301, 302}

    two = stages["near_dedup"](spark, one, str(tmp_path))
    label = {(d, f): c for d, f, c in test_simhash.brute_components([(r[0], r[1]) for r in kept])}
    want = {r for r in kept if label[r[0], test_simhash.brute_fingerprint(r[1])] == r[0]}
    assert two.columns == columns and key(two.select(*columns[:4]).collect()) == key(want)
    assert not any(200 <= r[0] < 300 for r in want)

    three = stages["decontamination"](spark, two, str(tmp_path))
    dirty = {d for d, _, n, _ in test_decontaminate.brute([(r[0], r[1]) for r in want], [(1, ITEM), (2, "zz yy")]) if n}
    left = {r for r in want if r[0] not in dirty}
    assert dirty == {303} and three.columns == columns
    assert key(three.select(*columns[:4]).collect()) == key(left)

    four = stages["mixing"](spark, three, str(tmp_path))
    assert four.columns == columns and key(four.select(*columns[:4]).collect()) == key(left)

    five = stages["sharding"](spark, four, str(tmp_path))
    assert key(five.select(*columns[:4]).collect()) == key(left)
    assert {r.shard_id for r in five.collect()} == {"-"}


def test_run(spark, tmp_path):
    rows = corpus(random.Random(43))
    write(spark, tmp_path, rows, [(1, ITEM)])
    got = cp.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in got}) == len(got) > 100


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_operators_take_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).collect()[0].spans == []
