import json
import math
import random
import re

from caseweave.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, phrases, templates, containment, slack):
    w = words(text)
    starts, base = [], set()
    for p, label in phrases.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    blocks = []
    for label, t in templates:
        tw = words(t)
        tokens, size = set(tw), math.ceil(slack * len(tw))
        need = math.ceil(containment * len(tokens) - 1e-9)
        start = 0
        while True:  # by the definition: every run of words that lies behind the last block
            runs = [(e, set(w[max(start, e - size + 1) : e + 1]) & tokens) for e in range(start, len(w)) if w[e] in tokens]
            good = [(e, k) for e, k in runs if len(k) >= need]
            if not good:
                break
            e, k = max(((e, k) for e, k in good if e < good[0][0] + size), key=lambda x: (len(x[1]), -x[0]))
            a = max(start, e - size + 1)
            while w[a] not in tokens or w[a] in w[a + 1 : e + 1]:
                a += 1
            blocks.append((label, a, e, len(k) / len(tokens)))
            start = e + 1
    score = 1.0 if base else max((c for *_, c in blocks), default=0.0)
    return len(w), sorted(starts), sorted(base), sorted(blocks), score


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, labels string")
    return {r.doc_id: (r.n_words, r.starts, r.base_labels, sorted((b.label, b.first, b.last, b.containment) for b in r.blocks), r.score, r.template_labels) for r in licenses.license_scan(df, **more).collect()}


def test_against_brute_force(spark):
    rng = random.Random(13)
    phrases = {"aa bb": "one", "bb aa bb": "two", "cc": "three"}
    templates = [("t1", "aa bb cc dd ee ff"), ("t2", "dd ee, dd gg hh"), ("t3", "éé xx yy zz"), ("t1", "q1 q2 aa")]
    pool = "aa bb cc dd ee ff gg hh éé xx yy zz q1 q2 q3 q4".split()
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "AA BB aa"), (203, "aabb aa_bb aabb bb"), (204, "a" * 70000 + " aa bb")]
    got = run(spark, rows, phrases=phrases, templates=templates, containment=0.7, slack=1.25)
    for d, t in rows:
        assert got[d][:5] == brute(t, phrases, templates, 0.7, 1.25), (d, t)
        assert {b[0] for b in got[d][3]} >= set(got[d][5]) and bool(got[d][3]) == bool(got[d][5])


def test_notices_and_clean_text(spark):
    rows = [
        (1, "x\nPermission is hereby granted, free of charge, to any person obtaining\n a copy of this Software and associated docs"),
        (2, "Released under the MIT License."),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "the and of this that is not a license to any person"),
        (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "under the mit license"),
    ]
    got = run(spark, rows)
    assert got[1][5] == ["mit"] and got[1][2] == [] and got[1][4] < 1
    assert got[2][1:4] == ([1], ["mit"], [])
    assert got[3][2] == ["cc-by-nc"]
    assert got[4][2:] == ([], [], 0.0, [])
    assert got[5][5] == ["gpl-3"]


def test_siblings_and_repeats(spark):
    by = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    nc = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    filler = " ".join(f"w{i}" for i in range(30))
    rows = [(1, by), (2, nc), (3, "This work is licensed under the GNU General Public License, version 2"), (4, f" {filler} ".join([by, nc, by])), (5, by * 10), (6, dict(licenses.TEMPLATES)["lgpl"])]
    got = run(spark, rows)
    assert [got[i][5] for i in (1, 2, 3, 4, 6)] == [["cc-by"], ["cc-by-nc"], ["gpl-2"], ["cc-by", "cc-by-nc"], ["lgpl"]]
    assert [b[1] for b in got[5][3] if b[0] == "cc-by"] == [13 * i for i in range(10)]
    assert {b[:3] for b in got[4][3]} >= {("cc-by", 0, 12), ("cc-by-nc", 43, 56), ("cc-by", 87, 99)}


def test_empty(spark):
    assert run(spark, []) == {}


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = licenses.op5_license_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, starts, base, blocks, score = brute(docs[r.doc_id], licenses.PHRASES, licenses.TEMPLATES, licenses.CONTAINMENT, licenses.SLACK)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(starts), min(starts, default=None), max(starts, default=None))
        found = json.loads(r.blocks)
        assert sorted((b["label"], b["first"], b["last"], b["containment"]) for b in found) == blocks
        assert r.base_labels == ",".join(base) and r.labels == ",".join(sorted({*base, *(b["label"] for b in found if b["best"])})) and r.score == score
