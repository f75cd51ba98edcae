import random
import zlib

import numpy as np

from caseweave.llm import language as la

EN, DE = "the cat sat on the mat and then it ran away", "der hund und die katze schlafen nicht im haus"


def some(rng, text, n):
    return " ".join(rng.choice(text.split()) for _ in range(n))


def brute_scores(model, text):
    c = [x if x.isalpha() else " " for x in text.lower()] + [" ", " "]
    total, n = model.prior.astype(float).copy(), 0
    for k in la.GRAMS:
        for i in range(len(c) - 2):
            g = c[i : i + k]
            if not any(x.isalpha() for x in g):
                continue
            h = sum(ord(x) * int(m) for x, m in zip(g, la._MULTIPLIERS)) & 0xFFFFFFFF
            mixed = ((h ^ h >> 15) * 0x2C1B3C6D + k * 0x27D4EB2F) & 0xFFFFFFFF
            total += model.log_p[:, (mixed ^ mixed >> 13) >> (32 - la.BITS)]
            n += 1
    z = total / max(n, 1) ** 0.5
    p = np.exp(z - z.max())
    return model.languages[int(total.argmax())], float((p / p.sum())[total.argmax()]), n


def model_of(spark, rows):
    return la.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(23)
    rows = [(i, some(rng, *((EN, 30) if i % 2 else (DE, 30))), "en" if i % 2 else "de") for i in range(60)] + [(99, None, "en"), (98, "xx", None)]
    model = model_of(spark, rows)
    texts = [some(rng, rng.choice([EN, DE]), rng.randint(1, 40)) for _ in range(30)] + ["Ärger!", "a", "a b", "12 a", "Z" * 50]
    for chunk in (la.CHUNK, 7):
        monkeypatch.setattr(la, "CHUNK", chunk)
        lang, score = model.predict(texts)
        for t, got, s in zip(texts, lang, score):
            want, p, _ = brute_scores(model, t)
            assert got == want and abs(s - p) < 1e-4, t


def test_no_letters_and_nulls(spark):
    model = model_of(spark, [(1, EN, "en"), (2, DE, "de")])
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (None, EN, "q"), (5, EN, "q"), (5, EN, "q")], "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred) for r in la.predict_language(df, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "en"), (5, "en")], key=str)
    assert la.predict_language(df.limit(0), model).collect() == []


def test_nothing_learned(spark):
    model = model_of(spark, [])
    df = spark.createDataFrame([(1, EN)], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in la.predict_language(df, model).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = la.op4_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [docs[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert sum(held) > 0.97 * len(held)


def test_learns_from_all_labelled_documents(spark):
    rows = [(i, "ab" if i % 2 else "abc", "en") for i in range(4000)] + [(5000, "xy", "de"), (5001, None, "de"), (5002, "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = la.fit(docs)
    assert np.allclose(model.prior, np.log([1 / 4001, 4000 / 4001]))
    one = np.zeros(1 << la.BITS)
    for text, n in (("ab", 2000), ("abc", 2000)):
        for _, grams in la.features([text]):
            for buckets, _ in grams:
                np.add.at(one, buckets, n)
    assert np.allclose(model.log_p[1], np.log((one + la.SMOOTH) / (one + la.SMOOTH).sum()), atol=1e-5)
