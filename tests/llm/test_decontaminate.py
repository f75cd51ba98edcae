import random
import re
from hashlib import sha256

import pytest

from caseweave.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    lengths = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    got |= items_
        out.append((d, len(w), len(hit), sorted(map(str, got))))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(a, t, 1, 2) for a, t in docs], "doc_id long, text string, row int, h int")
    i = spark.createDataFrame([(a, t, "z") for a, t in items], "item_id long, text string, spans string")
    got = dc.contamination(d, i, **more).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), sorted(map(str, r["items"]))) for r in got), key=str)


@pytest.mark.parametrize("bits", [None, 64])
def test_against_brute_force(spark, bits):
    rng = random.Random(11)
    pool = "aa bb cc dd éé 12 ff".split()
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 8, 9, 10, 11, 14, 30]))) for i in range(12)] + [(50, None), (51, " .,"), (52, "solo"), (53, "a b c d e"), (None, text(20))]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1) if w else 0
            parts += [", ".join(w[a : a + rng.choice([4, 9, 10, 12, 40])]).upper(), text(rng.randint(0, 5))]
        docs.append((i, " ".join(parts)))
    docs += [(90, None), (91, ""), (92, "..."), (93, items[7][1]), (None, items[8][1]), (93, items[7][1])]
    want = [(d, n, h, [x for x in g]) for d, n, h, g in brute(docs, items)]
    assert run(spark, docs, items, bits=bits) == [(d, n, h, [x for x in g if x != "None"]) for d, n, h, g in want]


def test_empty(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.op6_decontaminate(spark, sf).collect())
    assert got == sorted((d, n, h, len(g), sha256(",".join(g).encode()).hexdigest(), h > 0) for d, n, h, g in brute(docs, items))
    assert any(r[5] for r in got)
