import math
import random

from caseweave.llm import url_filter as uf


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), h + p, a) for a, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, default=(0, None, None))[1:]


URLS = [None, "", "no scheme", "HTTP://A.COM/x", "http://com", "http://com/", "http://xcom/", "http://www.example.com/en/1", "http://m.example.com/en/?q", "http://Example.com?x=/en/", "http://b.net/es/#a/b", "http://b.net/fr", "a://b.net://c.com/", "http://é.net/fr/", "http://x.org/\nz", "http://b.net/fr/" + "y" * 50000]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    return {r.page_id: r for r in uf.url_verdicts(df, **more).collect()}


def test_rules(spark):
    got = run(spark, list(enumerate(URLS)) + [(None, "http://b.net/fr/1")])
    for i, u in enumerate(URLS):
        host, path, (rule, verdict) = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[None].verdict == "block"


def test_empty_and_one_class(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, "http://x.org/a")])[1].verdict == "allow"


def witten_bell(urls, order):
    """Dictionaries of what follows each context (None before a URL's start), and the probability by the definition."""
    follow = {}
    for u in urls:
        for i, c in enumerate(u):
            for k in range(order + 1):
                ctx = (k, tuple(u[j] if j >= 0 else None for j in range(i - k, i)))
                follow.setdefault(ctx, {}).setdefault(c, 0)
                follow[ctx][c] += 1

    def log_p(u, i):
        p = 1 / 256
        for k in range(order + 1):
            seen = follow.get((k, tuple(u[j] if j >= 0 else None for j in range(i - k, i))))
            if seen:
                p = (seen.get(u[i], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return math.log(p)

    return log_p


def some_urls(seed=19, n=400):
    rng = random.Random(seed)
    good = [f"https://news{rng.randint(0, 99)}.example.org/story/{rng.randint(0, 999)}" for _ in range(n)]
    bad = [f"http://win-{rng.randint(0, 99)}.example.biz/?pills={rng.randint(0, 999)}" for _ in range(n)]
    return good, bad


def test_likelihood_equals_the_definition_and_is_a_distribution():
    good = [u.encode() for u in some_urls()[0]]
    for order in (0, 1, 3, 5):
        model, want = uf.MarkovModel(uf.pairs_of(good[:40], order)), witten_bell(good[:40], order)
        for u in (good[50], b"http://x", b"zz\xc3\xa9", b"h"):
            data, bounds = uf._joined([u])
            assert all(abs(a - want(u, i)) < 1e-9 for i, a in enumerate(model.log_likelihood(data, bounds)))
    for prefix in (b"", b"htt", b"zzz", b"https://news1"):
        data, bounds = uf._joined([prefix + bytes([c]) for c in range(256)])
        p = model.log_likelihood(data, bounds)[bounds[1:] - 1]
        assert abs(sum(math.exp(x) for x in p) - 1) < 1e-9


def fitted(spark, good, bad, **more):
    rows = [(u, True) for u in good] + [(u, False) for u in bad]
    return uf.fit(spark.createDataFrame(rows, "url string, allow boolean").repartition(3), **more)


def test_fit_tells_urls_apart_and_counts_each_distinct_url_once(spark):
    good, bad = some_urls()
    one, many = fitted(spark, good[:300], bad[:300]), fitted(spark, good[:300] + good[:1] * 500, bad[:300] * 2)
    for s in (one, many):
        assert (s.scores([u.encode() for u in good[300:]]) >= s.threshold).mean() > 0.98
        assert (s.scores([u.encode() for u in bad[300:]]) < s.threshold).mean() > 0.98
        assert s.right > 0.98
    assert one.threshold == many.threshold
    assert all((a == b).all() for x, y in zip(one.models[0].tables, many.models[0].tables) for a, b in zip(x[1:], y[1:]))


def test_a_hot_url_and_a_small_model(spark):
    good, bad = some_urls()
    hot = spark.range(300_000).selectExpr("'http://hot.example.com/' AS url", "true AS allow")
    rest = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, allow boolean")
    s = uf.fit(hot.unionByName(rest), most_pairs=300)
    for m in s.models:  # the bound, but for the last step of equally frequent contexts
        assert sum(len(t[4]) for t in m.tables) <= 300 and len(m.tables[0][1]) == 1
    assert s.right > 0.95
    whole = uf.fit(hot.unionByName(rest))
    assert sum(len(t[4]) for t in whole.models[0].tables) > 1000


def test_contexts_that_are_not_held_count_all_the_same(spark, monkeypatch):
    good, bad = some_urls(n=150)
    good, bad = [u.replace("example.org", "example.com") for u in good], [u.replace(".biz/", ".net/es/") for u in bad]
    free = [f"http://win-{i}.example.org/story/{i * 7}" for i in range(60)] + ["", "é", "h", "http://x.org/" + "z9" * 400]
    rows = list(enumerate([None, *good, *bad, *free, *free[:1] * 500])) + [(0, free[0]), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")

    def verdicts(**more):
        return sorted(uf.url_verdicts(df, **more).collect(), key=str)

    whole = verdicts()
    assert len(whole) == len(rows) and {r.verdict for r in whole if not r.rule} == {"allow", "block"}
    assert verdicts(most_pairs=300) == whole
    monkeypatch.setattr(uf, "CHUNK", 300)  # many chunks, nearly all joined
    assert verdicts(most_pairs=1) == whole
    ruled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, allow boolean")
    some, every = uf.fit(ruled, most_pairs=300), uf.fit(ruled)
    assert every.rest is None and (some.threshold, some.right) == (every.threshold, every.right)
    # what is held and the rest together are the whole models
    kept = [sum(len(t[4]) for t in m.tables) for m in some.models]
    assert sum(kept) + some.rest.filter("what % 2 = 1").count() == sum(len(t[4]) for m in every.models for t in m.tables)


def test_threshold_is_the_best_cut():
    rng = random.Random(5)
    model = uf.MarkovModel(uf.pairs_of([b"x"], 0))
    for _ in range(200):
        good = {rng.randint(-6, 9): rng.randint(1, 5) for _ in range(rng.randint(1, 6))}
        bad = {rng.randint(-9, 6): rng.randint(1, 5) for _ in range(rng.randint(1, 6))}
        s = uf.UrlScorer(model, model)
        s.calibrate(good, bad)

        def right(cut):
            return (sum(n for b, n in good.items() if b * uf.BIN >= cut) / sum(good.values()) + sum(n for b, n in bad.items() if b * uf.BIN < cut) / sum(bad.values())) / 2

        every = [right(x * uf.BIN / 2) for x in range(-22, 23)]
        assert abs(right(s.threshold) - max(every)) < 1e-9 and abs(s.right - max(every)) < 1e-9


def test_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = uf.op8_url_filter(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, (rule, verdict) = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
