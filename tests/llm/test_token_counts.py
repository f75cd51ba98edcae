import random

import pytest
from pyspark.sql import functions as F

from caseweave.llm import token_counts as tc
from caseweave.llm._common import tokenizer_path


@pytest.fixture(scope="module")
def count():
    return tc.Counter(tokenizer_path("byte_bpe_50k.tiktoken"))


BITS = ["word", " two", "  ", "\n", "'s", "'", "re", " l", "l", "12", " 3", "é", "日本", "!?", " .", "\t", "x'", "ve", " ", "😀", "́"]


def some(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_pieces_cover_the_text(count):
    rng = random.Random(1)
    for _ in range(200):
        t = some(rng, 60)
        assert "".join(count.pieces(t)) == t
        assert sum(count.counts(count.pieces(t))) == len(count.encoding.encode_ordinary(t))


@pytest.mark.parametrize("leaf", [1, 2, 5, 32])
def test_edits_equal_counting_anew(count, leaf):
    rng = random.Random(leaf)
    for _ in range(400):
        text = some(rng, rng.choice([0, 1, 5, 40, 200]))
        tree = tc.CountTree(text, count, leaf=leaf)
        edits, at = [], 0
        while at <= len(text) and rng.random() < 0.8:
            s = rng.randint(at, len(text))
            e = min(len(text), s + rng.choice([0, 0, 1, 2, 10]))
            edits.append((s, e, some(rng, rng.choice([0, 1, 2, 8, 60]))))
            at = e + 1
        want, kept = text, [x for x in edits if x[1] > x[0] or x[2]]
        for s, e, new in reversed(kept):
            want = want[:s] + new + want[e:]
        assert tree.edit(edits) == len(kept)
        assert tree.text == want
        pieces = count.pieces(want)
        assert tree.totals == (len(want), len(pieces), len(count.encoding.encode_ordinary(want)))
        again = [0, 0, 0]
        for x in tree.leaves:
            again = [a + b for a, b in zip(again, x)]
        assert tuple(again) == tree.totals


def test_a_small_edit_encodes_little(count):
    text = "some words here. " * 5000
    tree = tc.CountTree(text, count)
    tree.encoded = 0
    tree.edit([(40_000, 40_004, "thing")])
    assert tree.encoded <= 4 * tc.LEAF


def test_overlapping_and_outside_edits(count):
    tree = tc.CountTree("abc def", count)
    assert tree.edit([(2, 5, "X"), (1, 4, "Y"), (90, 99, "!"), (-5, 0, ">")]) == 3
    assert tree.text == ">aYdef!"


def test_rows(spark, count):
    rows = [(1, None, 9), (2, "", 9), (3, "hello  world" * 50, 9), (None, "x", 9), (3, "hello  world" * 50, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tc.count_tokens(df).withColumn("edits", F.expr("array(named_struct('start', 3L, 'end', 5L, 'new', ' you'))"))
    for r in tc.recount_tokens(got).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        want = text[:3] + " you" + text[5:]
        assert r.text == want and r.n_tokens == len(count.encoding.encode_ordinary(want)) and r.n_edits == 1
    assert tc.recount_tokens(got.limit(0)).collect() == []


def test_query(spark, sf, count):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = tc.op3_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        assert r.n_tokens == len(count.encoding.encode_ordinary(text))
        done = 0
        out, at = "", 0
        for s, e, new in sorted(tc.redactions(text)):
            if s >= at:
                out, at, done = out + text[at:s] + new, e, done + 1
        assert r.n_edits == done and r.n_tokens_after == len(count.encoding.encode_ordinary(out + text[at:]))


def test_a_missing_vocabulary_is_named():
    with pytest.raises(FileNotFoundError, match="on every worker"):
        tc.Counter("/nowhere/ranks")
