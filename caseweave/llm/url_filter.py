"""URL filters (8): character language models of accepted and rejected URLs, and host and path rules."""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ids_only, materialize, read_table, small_batches

# The rules of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The longest context, in bytes of the URL.
ORDER = 5
#: Pairs of a context and a byte that the driver and every task hold of a class, at most (24 bytes each). Where the
#: ruled URLs have more, contexts that were seen least often stay in a table, and are joined to the URLs that need them.
MOST_PAIRS = 1 << 20
#: Bytes of distinct URLs that look up together what isn't held: 12 keys a byte at most, before repeats are dropped.
CHUNK = 1 << 19
#: Distinct URLs of each class that it takes to hold some out.
HOLD_FROM = 10
#: Scores are binned by this to find the threshold; they lie within +-RANGE.
BIN, RANGE = 1 / 2048, 16
#: Pairs that a task gathers before it sums them up and sends them on.
GATHER = 1 << 21


class MarkovModel:
    """Bytes of URLs given the 0 to `order` bytes before, each order smoothed by the next shorter (Witten-Bell).

    Contexts and what follows them are 64-bit hashes in sorted arrays with their counts. An unseen context leaves the
    probability to the next shorter. Contexts that aren't held are given where they are needed (rest)."""

    def __init__(self, pairs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """pairs: for each order hashes of the contexts, hashes of contexts with their byte, and counts."""
        self.tables = []
        for k in sorted(pairs):
            ctx, full, n = pairs[k]
            contexts, of = np.unique(ctx, return_inverse=True)
            order = np.argsort(full)
            self.tables.append((k, contexts, np.bincount(of, n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts)), full[order], n[order]))

    def log_likelihood(self, data: np.ndarray, bounds: np.ndarray, rest: dict[int, tuple[np.ndarray, ...]] | None = None) -> np.ndarray:
        """The natural logarithm of the probability of each byte.

        rest: for orders the contexts that aren't held, as in tables: contexts, totals, kinds, pairs, counts."""
        p = np.full(len(data), 1 / 256)
        for k, *held in self.tables:
            ctx, full = _contexts(data, bounds, k)
            t, own, c = np.zeros(len(data)), np.zeros(len(data)), np.zeros(len(data))
            for contexts, total, kinds, pairs, n in (held, *([rest[k]] if rest and k in rest else [])):  # a context is in one of them
                t += _look(contexts, ctx, total)
                own += _look(contexts, ctx, kinds)
                c += _look(pairs, full, n)
            seen = t > 0
            p[seen] = (c[seen] + own[seen] * p[seen]) / (t[seen] + own[seen])
        return np.log(p)


def pairs_of(urls: list[bytes], order: int = ORDER) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct pairs of URLs and their counts, for each order: contexts, contexts with the byte, counts."""
    data, bounds = _joined(urls)
    out = {}
    for k in range(order + 1):
        ctx, full = _contexts(data, bounds, k)
        full, first, n = np.unique(full, return_index=True, return_counts=True)
        out[k] = ctx[first], full, n
    return out


def _has(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return _look(keys, wanted, np.ones(len(keys), dtype=bool)) > 0


def _look(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _joined(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(urls) + 1, dtype=np.int64)
    np.cumsum([len(u) for u in urls], out=bounds[1:])
    return np.frombuffer(b"".join(urls), dtype=np.uint8), bounds


def _contexts(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k bytes before each byte (zeros before a URL's start), and of these with the byte."""
    ctx = np.full(len(data), np.uint64(k + 1), dtype=np.uint64)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.arange(len(data))
    for j in range(1, k + 1):
        b = np.where(at - j >= start, data[np.maximum(at - j, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        ctx = _mix(ctx, b)
    return ctx, _mix(ctx, data.astype(np.uint64) + np.uint64(1))


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class UrlScorer:
    """The two models, and the least length-normalised difference of log-likelihoods that is accepted.

    Without URLs of one of the classes nothing can be told: every score is 0 and accepted. right is the mean of both
    classes' shares of right verdicts at the threshold, on URLs that the models haven't seen. rest is the table of what
    the models have but don't hold (_REST), or None if they hold all; with_scores joins it."""

    def __init__(self, accepted: MarkovModel | None = None, rejected: MarkovModel | None = None, rest: DataFrame | None = None):
        self.models = (accepted, rejected) if accepted and rejected else None
        self.threshold, self.right, self.rest = 0.0, None, rest

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}  # tables stay where they are

    def calibrate(self, good: dict[int, int], bad: dict[int, int]) -> None:
        """Set the threshold from how many scores of held-out URLs fall into each bin: of all cuts between bins the one
        with the most right, and of equal ones the one nearest 0."""
        if self.models is None or not good or not bad:
            return
        every = np.array(sorted({*good, *bad}))
        g, b = (np.array([x.get(i, 0) for i in every.tolist()], dtype=np.float64) for x in (good, bad))
        # cut j lies below bin j; the last above all
        right = (np.append(np.cumsum(g[::-1])[::-1], 0) / g.sum() + np.append(0, np.cumsum(b)) / b.sum()) / 2
        cuts = np.concatenate([[every[0]], (every[1:] + every[:-1] + 1) / 2, [every[-1] + 1]]) * BIN
        best = np.flatnonzero(right >= right.max() - 1e-12)
        self.threshold = float(cuts[best[np.argmin(np.abs(cuts[best]))]])
        self.right = float(right.max())

    def scores(self, urls: list[bytes], rest: tuple[dict, dict] = ({}, {})) -> np.ndarray:
        """(accepted's - rejected's log-likelihood) / bytes; 0 for an empty URL. Each URL is summed up by itself, so
        that its score is the same, to the last bit, beside any others. rest: what the models don't hold of these URLs."""
        data, bounds = _joined(urls)
        if self.models is None or not len(data):
            return np.zeros(len(urls))
        d = self.models[0].log_likelihood(data, bounds, rest[0]) - self.models[1].log_likelihood(data, bounds, rest[1])
        size = np.diff(bounds)
        return np.bincount(np.repeat(np.arange(len(urls)), size), d, minlength=len(urls)) / np.maximum(size, 1)

    def wanted(self, urls: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Distinct keys of rest, and what they are (_REST), of all contexts that one of the models doesn't hold."""
        data, bounds = _joined(urls)
        for (k, one, *_), (_, other, *_) in zip(*(m.tables for m in self.models), strict=True):
            ctx, full = _contexts(data, bounds, k)
            away = ~(_has(one, ctx) & _has(other, ctx))
            yield 2 * k, np.unique(ctx[away])
            yield 2 * k + 1, np.unique(full[away])


_PAIRS = ["allow", "k", "ctx", "pair", "n"]
#: What models have but don't hold: what it is (2k: a context of order k, 2k + 1: one with its byte), the hash, the
#: class, the count, and of contexts how many bytes follow.
_REST = ["what", "key", "allow", "n", "kinds"]


def _counted(order: int):
    """Sums up the pairs of a partition's URLs (url, allow), some GATHER of them at a time."""

    def summed(held: list[tuple[bool, int, tuple]]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bool, int], list[tuple]] = {}
        for allow, k, x in held:
            groups.setdefault((allow, k), []).append(x)
        for (allow, k), xs in groups.items():
            ctx, full, n = (np.concatenate(c) for c in zip(*xs, strict=True))
            full, first, of = np.unique(full, return_index=True, return_inverse=True)
            size = len(full)
            cols = (np.full(size, allow), np.full(size, k, dtype=np.int32), ctx[first].view(np.int64), full.view(np.int64), np.bincount(of, n, minlength=size).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for allow in (True, False):
                urls = [u.encode() for u, a in zip(b.column("url").to_pylist(), b.column("allow").to_pylist(), strict=True) if a == allow]
                for k, x in pairs_of(urls, order).items():
                    held.append((allow, k, x))
                    size += len(x[1])
            if size > GATHER:
                yield from summed(held)
                held, size = [], 0
        yield from summed(held)

    return run


def fit(ruled: DataFrame, order: int = ORDER, most_pairs: int = MOST_PAIRS) -> UrlScorer:
    """A scorer of ruled URLs (url, allow: boolean).

    All distinct URLs count, each once, so that no hot URL outweighs the rest. Of HOLD_FROM or more of each class every
    fifth, by a hash, is held out to set the threshold (else all are used for both). The executors sum up the pairs of
    the models; of each class some `most_pairs` come to the driver, those of the contexts seen most often (all orders
    alike; a context comes whole), and of the held-out scores one count for each bin. Other contexts are none the less
    of the models: they stay in the table `rest`, which with_scores joins, so that scores don't depend on `most_pairs`."""
    urls = materialize(ruled.filter("url IS NOT NULL").groupBy("url").agg(F.bool_and("allow").alias("allow")))
    held = F.pmod(F.xxhash64("url", F.lit("held")), F.lit(5)) == 0
    sizes = {r.allow: (r.n, r.out) for r in urls.groupBy("allow").agg(F.count("*").alias("n"), F.count_if(held).alias("out")).collect()}
    if len(sizes) < 2:
        return UrlScorer()
    split = all(n >= HOLD_FROM and 0 < out < n for n, out in sizes.values())
    small_batches(urls.sparkSession)
    counted = urls.filter(~held if split else F.lit(True)).mapInArrow(_counted(order), "allow boolean, k int, ctx long, pair long, n long")
    pairs = materialize(counted.groupBy("allow", "k", "ctx", "pair").agg(F.sum("n").alias("n")))
    contexts = pairs.groupBy("allow", "k", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    contexts = contexts.withColumn("often", F.floor(8 * F.log2("total")).cast("int"))
    steps = contexts.groupBy("allow", "often").agg(F.sum("kinds").alias("pairs")).collect()  # a few hundred rows
    least = {}
    for allow in (True, False):
        total = 0
        for r in sorted((r for r in steps if r.allow == allow), key=lambda r: -r.often):
            total += r.pairs
            if total > most_pairs and allow in least:
                break
            least[allow] = r.often
    often = F.when(F.col("allow"), least.get(True, 0)).otherwise(least.get(False, 0))
    rest = None
    if any(r.often < least[r.allow] for r in steps):
        chosen = contexts.filter(F.col("often") >= often).select("allow", "k", "ctx")
        seldom = contexts.filter(F.col("often") < often)
        own = seldom.select((2 * F.col("k")).alias("what"), F.col("ctx").alias("key"), "allow", F.col("total").alias("n"), "kinds")
        with_byte = pairs.join(seldom.select("allow", "k", "ctx"), ["allow", "k", "ctx"], "left_semi")
        with_byte = with_byte.select((2 * F.col("k") + 1).alias("what"), F.col("pair").alias("key"), "allow", "n", F.lit(0).cast("long").alias("kinds"))
        rest = materialize(own.unionByName(with_byte))
        pairs = pairs.join(chosen, ["allow", "k", "ctx"], "left_semi")
    got = pairs.select(*_PAIRS).toArrow()
    allow, k, ctx, full, n = (got.column(c).to_numpy() for c in _PAIRS)
    models = []
    for kind in (True, False):
        own = {i: (allow == kind) & (k == i) for i in range(order + 1)}
        models.append(MarkovModel({i: (ctx[at].view(np.uint64), full[at].view(np.uint64), n[at]) for i, at in own.items()}))
    scorer = UrlScorer(*models, rest)
    at = F.floor(F.greatest(F.least("score", F.lit(float(RANGE))), F.lit(float(-RANGE))) / BIN).cast("int")
    found = with_scores(urls.filter(held if split else F.lit(True)), scorer).groupBy("allow", at.alias("bin")).agg(F.count("*").alias("n")).collect()
    scorer.calibrate({r.bin: r.n for r in found if r.allow}, {r.bin: r.n for r in found if not r.allow})
    return scorer


def with_scores(urls: DataFrame, scorer: UrlScorer) -> DataFrame:
    """urls (url, null as empty, and other columns) with a column score.

    What the models hold is broadcast. If that isn't all, the rest comes by a join: URLs are laid in chunks of CHUNK
    bytes, a chunk asks the table for each distinct key once, and is scored with the answers. Rows move with their
    chunks then, so they should be distinct and narrow."""
    spark = urls.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    names = urls.columns

    def texts(b: pa.RecordBatch | pa.Table) -> list[bytes]:
        return [(u or "").encode() for u in b.column("url").to_pylist()]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(texts(b)), pa.float64())], [*names, "score"])

    if scorer.rest is None:
        return urls.mapInArrow(held, f"{schema}, score double")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            own = []
            for u in texts(b):
                if size >= CHUNK:
                    chunk, size = chunk + 1, 0
                own.append(chunk)
                size += len(u)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], [*names, "__chunk"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in groupby(((c, u) for b in batches for c, u in zip(b.column("__chunk").to_pylist(), texts(b), strict=True)), itemgetter(0)):
            for what, keys in shared.value.wanted([u for _, u in rows]):
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, what, dtype=np.int32)), pa.array(keys.view(np.int64))], ["__chunk", "what", "key"])

    def answered(rows: pa.Table, found: pa.Table) -> pa.Table:
        s = shared.value.scores(texts(rows), _rest_tables(found))
        return rows.select(names).append_column("score", pa.array(s, pa.float64()))

    chunks = materialize(urls.mapInArrow(laid, f"{schema}, __chunk long"))  # both sides must see the same chunks
    found = chunks.mapInArrow(asked, "__chunk long, what int, key long").join(scorer.rest, ["what", "key"]).select("__chunk", *_REST)
    return chunks.groupBy("__chunk").cogroup(found.groupBy("__chunk")).applyInArrow(answered, f"{schema}, score double")


def _rest_tables(found: pa.Table) -> tuple[dict, dict]:
    """For both models what rows of _REST say of each order: sorted contexts, totals, kinds, sorted pairs, counts."""
    what, key, allow, n, kinds = (found.column(c).to_numpy() for c in _REST)
    out = ({}, {})
    for tables, kind in zip(out, (True, False), strict=True):
        for k in np.unique(what // 2).tolist():
            table = []
            for w, values in ((2 * k, (n, kinds)), (2 * k + 1, (n,))):
                at = np.flatnonzero((what == w) & (allow == kind))
                keys, first = np.unique(key[at].view(np.uint64), return_index=True)
                table += [keys, *(v[at[first]] for v in values)]
            tables[k] = tuple(table)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Else empty."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, parts, 2)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Which URLs are accepted: page_id, host, path, rule (host and path of the longest that fits, else null),
    score (of the language models) and verdict: the rule's, else by the score.

    pages: page_id, url; other columns are ignored, and not read. The models learn from all distinct URLs that rules
    decide (fit). What driver and tasks hold of them is bounded by `most_pairs`, whatever the input; the rest is joined
    (with_scores), so results don't depend on it. Every URL is then scored whole.

    Null counts as the empty URL: no host, no path, no rule, score 0. Ties between rules of one length go to the
    first listed. Repeated rows each return a row. Empty table: no rows.
    """
    pages = ids_only(pages, ("page_id", "url"))
    host, path = host_and_path(F.col("url"))
    byname = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = F.coalesce(*[F.when(_fits(F.col("host"), F.col("path"), r), F.lit(r[1] + r[2])) for r in byname], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(F.col("rule") == r[1] + r[2], F.lit(r[0])) for r in byname], F.lit(None).cast("string"))
    ruled = pages.withColumns({"host": host, "path": path}).withColumn("rule", rule).withColumn("by_rule", verdict)
    scorer = fit(ruled.filter("by_rule IS NOT NULL").select("url", (F.col("by_rule") == "allow").alias("allow")), order, most_pairs)
    if scorer.rest is None:
        scored = with_scores(ruled, scorer)
    else:  # a plain join, which the adaptive skew join splits at hot URLs
        scored = ruled.join(with_scores(ruled.select("url").filter("url IS NOT NULL").distinct(), scorer), "url", "left")
    score = F.coalesce("score", F.lit(0.0))
    return scored.select("page_id", "host", "path", "rule", score.alias("score"), F.coalesce("by_rule", F.when(score >= scorer.threshold, "allow").otherwise("block")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL: host, path, the rule that decides it, and the verdict."""
    return url_verdicts(read_table(spark, sf_dir, "pages"))
