import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from caseweave.llm import simhash
from caseweave.operators.graph import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [(d, brute_fingerprint(t)) for d, t in rows]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i][1] ^ fp[j][1]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(fp):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, f) in enumerate(fp):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((d, f, min(ids) if ids else None))
    return out


TEXTS = ["", None, " \n\t", "One", "one", "a b c", "A B C D", "a b c d e f", "x\x0by z é É", "  nbsp stays", "ß" * 50]


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("alpha beta Gamma δ ee".split()) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    got = simhash.fingerprints(pa.array(texts))
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts]


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(3000))
    monkeypatch.setattr(simhash, "_blocks", lambda n, block=100, f=simhash._blocks: f(n, 100))
    got = simhash.fingerprints(pa.array(["a b", text, "c d e f g"]))
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in ("a b", text, "c d e f g")]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def counts(x):
        return [[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x]

    real = [sum(abs(p - q) for p, q in zip(x, y)) for x, y in zip(counts(a[:300]), counts(b[:300]))]
    assert simhash.manhattan(simhash.embed(a), simhash.embed(b))[:300].tolist() == real
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) <= np.bitwise_count(a ^ b)).all()


def near(rng, n, centres):
    out = set()
    for _ in range(n):
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


def check_links(spark, fps, **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    comp = {r.node: r.component for r in components(simhash.fingerprint_links(df, **more)).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = {}
    for i, s in enumerate(signed):
        want.setdefault(find(i), set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(comp.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    check_links(spark, near(rng, 700, [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]))


def test_large_cells_are_dealt(spark):
    rng = random.Random(4)
    check_links(spark, near(rng, 600, [rng.getrandbits(64) for _ in range(3)]), cell=20)


def test_components_of_documents(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice("lorem ipsum dolor sit amet sed do eius".split()) for _ in range(400)).split()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(100, 160):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["one", "two"])
        rows.append((i, " ".join(words)))
    rows += [(None, base[0]), (None, "only here"), (100, rows[-1][1]), (100, rows[-1][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).collect() == []
