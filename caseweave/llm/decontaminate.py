"""Benchmark decontamination (6): winnowed k-gram fingerprints, a join of training and test, extended hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ids_only, materialize, read_table, small_batches
from ._words import IN_WORD, Words, grams, text_chunks

#: Consecutive item words that count as contamination.
SPAN = 10
#: Words of a fingerprint. With windows of SPAN - K + 1 fingerprints, each shared span of SPAN words has a shared one.
K = 5
#: Bits of the sieve that documents' fingerprints pass before they are joined: for each fingerprint of the benchmark, at
#: least, and at most (32 MB, which suit some 10^7 fingerprints; a fuller sieve only lets more through to the join).
SIEVE_EACH = 32
SIEVE_BITS = (1 << 20, 1 << 28)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)

_HIT = "h long, n int, pos int, at int, ctx string"


def _winnow(w: Words, h: np.ndarray, span: int, k: int) -> np.ndarray:
    """Positions (over all texts) of the k-grams that are the least, and of equal ones the last, in some window of
    span - k + 1 k-grams of one text: a window is span words, so every span of that length has one of them."""
    g = grams(h, k)
    width = span - k + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), g
    best, at = g[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        less = g[j : j + n] <= best
        best[less] = g[j : j + n][less]
        at[less] = j
    owner = w.owner()
    return np.unique((np.arange(n) + at)[owner[:n] == owner[span - 1 :]]), g


def _context(w: Words, owner: int, p: int, k: int, reach: int) -> tuple[int, str]:
    """The k words at p with up to reach words either side within the text, and how many stand before p."""
    lo, hi = max(int(w.first[owner]), p - reach), min(int(w.first[owner + 1]), p + k + reach)
    return p - lo, b" ".join(w.word(i) for i in range(lo, hi)).decode()


def _passes(sieve: bytes, bits: int):
    table = np.frombuffer(sieve, dtype=np.uint8)

    def run(h: np.ndarray) -> np.ndarray:
        b = h & np.uint64(bits - 1)
        return (table[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return run


def _scan(w: Words, lengths: list[int], span: int, k: int, passes) -> list[list[tuple]]:
    """The fingerprints of each text that pass: (hash, words of the gram, position, words before it in the context, context).

    Besides the winnowed k-grams these are, for each of the lengths (those of items of fewer than span words), all
    n-grams of that length: such an item is one window and is matched whole."""
    out: list[list[tuple]] = [[] for _ in range(len(w.bounds) - 1)]
    if not len(w.starts):
        return out
    h, owner = w.hashes(), w.owner()
    for n, every in [(k, False), *((n, True) for n in lengths)]:
        if every:
            g = grams(h, n)
            p = np.flatnonzero(owner[: len(g)] == owner[n - 1 :]) if len(g) else np.zeros(0, dtype=np.int64)
            g = g ^ _MAX if n == k else g  # whole items of k words are a kind of their own
        else:
            p, g = _winnow(w, h, span, k)
        p = p[passes(g[p])]
        reach = 0 if every else span - k
        for i, hash_, of in zip(p.tolist(), g[p].view(np.int64).tolist(), owner[p].tolist(), strict=True):
            before, ctx = _context(w, of, i, n, reach)
            out[of].append((hash_, n if every else -n, i - int(w.first[of]), before, ctx))
    return out


def _all(h: np.ndarray) -> np.ndarray:
    return np.ones(len(h), dtype=bool)


def item_fingerprints(items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Every window of the items as fingerprints: item_id, h, n, at, ctx. n is -k for a winnowed k-gram, and the
    number of words of an item that is matched whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column("item_id").to_pylist(), []
            for first, w in text_chunks(b.column("text"), IN_WORD):
                size = np.diff(w.first)
                found = _scan(w, sorted({int(x) for x in size if 0 < x < span}), span, k, _all)
                for i, hits in enumerate(found):
                    whole = 0 < size[i] < span
                    rows += [(ids[first + i], hit) for hit in hits if (hit[1] == size[i] if whole else hit[1] < 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], b.column("item_id").type), *(pa.array([r[1][j] for r in rows], t) for j, t in ((0, pa.int64()), (1, pa.int32()), (3, pa.int32()), (4, pa.string())))],
                ["item_id", "h", "n", "at", "ctx"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return ids_only(items, ("item_id", "text")).mapInArrow(run, f"item_id {kind}, h long, n int, at int, ctx string")


def document_hits(docs: DataFrame, sieve: bytes, lengths: list[int], bits: int, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, and the fingerprints that pass the sieve, of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    id_type = ids_only(docs, ("doc_id",)).schema[0].dataType.simpleString()
    hit = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("at", pa.int32()), ("ctx", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _passes(shared.value, bits)
        for b in batches:
            hits, words = [], []
            for _, w in text_chunks(b.column("text"), IN_WORD):
                words.append(np.diff(w.first))
                hits += [[dict(zip(("h", "n", "pos", "at", "ctx"), x, strict=True)) for x in found] for found in _scan(w, lengths, span, k, passes)]
            n = np.concatenate(words) if words else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, hit)], ["doc_id", "n_words", "hits"])

    small_batches(docs.sparkSession)
    return ids_only(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {id_type}, n_words long, hits array<struct<{_HIT.replace(' ', ':').replace(',:', ',')}>>")


def _extended(span: int, k: int):
    """Extends the joined hits word by word: (row, start, end, window) of those that hold a whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, lo, hi = [], [], []
            cols = [b.column(c).to_pylist() for c in ("n", "pos", "at", "ctx", "item_at", "item_ctx")]
            for i, (n, pos, at, ctx, item_at, item_ctx) in enumerate(zip(*cols, strict=True)):
                a, c = ctx.split(" "), item_ctx.split(" ")
                if n > 0:
                    if a == c:
                        keep.append(i)
                        lo.append(pos)
                        hi.append(pos + n)
                    continue
                if a[at : at + k] != c[item_at : item_at + k]:
                    continue  # equal hashes of different words
                left = right = 0
                while left < min(at, item_at) and a[at - left - 1] == c[item_at - left - 1]:
                    left += 1
                while at + k + right < len(a) and item_at + k + right < len(c) and a[at + k + right] == c[item_at + k + right]:
                    right += 1
                if left + k + right >= span:
                    keep.append(i)
                    lo.append(pos - left)
                    hi.append(pos + k + right)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(keep, pa.int64())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), b.column("window").take(pa.array(keep, pa.int64()))], ["row", "lo", "hi", "window"])

    return run


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, bits: int | None = None) -> DataFrame:
    """Where benchmark items stand in documents: doc_id, n_words, spans (sorted, disjoint word ranges), items (sorted ids).

    docs: doc_id, text; items: item_id, text; other columns are ignored. Words are runs of letters and digits (all
    characters over 0x7F count) after lower-casing A-Z. A window is `span` consecutive words of an item, or the whole
    item if it is shorter; every document word inside any occurrence of a window is in a span.

    Both sides are winnowed alike, in one pass over each whole text. A document's fingerprints first pass a sieve of
    `bits` bits made from the items' fingerprints (by default as many as their number asks for, within SIEVE_BITS, so it
    is safe to send everywhere); the few that are left carry the words around them, and are joined to the items' by hash in a plain shuffled join, so
    neither side needs to be small, and no text is shuffled. Hits are then extended and checked word by word.
    Equal contexts of many items are one row with a number; hits carry that, and items are looked up by it once for
    each document.

    Null or empty texts have no words, no spans and no items; an item without words matches nothing. Repeated rows
    each return a row; null ids are kept. No items or no documents: no hits, or no rows.
    """
    if not 0 < k <= span:
        raise ValueError("k must be between 1 and span")
    spark = docs.sparkSession
    small_batches(spark)
    prints = materialize(item_fingerprints(items, span, k))
    lengths = sorted(r.n for r in prints.filter("n > 0").select("n").distinct().collect())  # below span: few numbers
    if bits is None:
        bits = min(SIEVE_BITS[1], max(SIEVE_BITS[0], 1 << (SIEVE_EACH * prints.count()).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = prints.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("mask")).toPandas()
    table = np.zeros(max(1, bits >> 6), dtype=np.int64)  # bits / 64 rows came at most
    table[words["word"].to_numpy(dtype=np.int64)] = words["mask"].to_numpy(dtype=np.int64)
    found = materialize(document_hits(docs, table.tobytes(), lengths, bits, span, k))
    found = found.withColumn("row", F.monotonically_increasing_id())  # of a written table: fixed
    context = ["h", "n", F.col("at").alias("item_at"), F.col("ctx").alias("item_ctx")]
    windows = materialize(prints.select(*context).distinct().withColumn("window", F.monotonically_increasing_id()))
    holders = prints.select("item_id", *context).join(windows, ["h", "n", "item_at", "item_ctx"]).select("window", "item_id").distinct()
    hits = found.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    joined = hits.join(windows, ["h", "n"]).select("row", "n", "pos", "at", "ctx", "item_at", "item_ctx", "window")
    kind = items.schema["item_id"].dataType.simpleString()
    spans = materialize(joined.mapInArrow(_extended(span, k), "row long, lo int, hi int, window long"))
    ranges = F.sort_array(F.collect_set(F.struct("lo", "hi")))
    named = spans.select("row", "window").distinct().join(holders, "window").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    per = spans.groupBy("row").agg(ranges.alias("r")).join(named, "row", "left")
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    last = lambda acc: F.element_at(acc, -1)
    joined_up = F.aggregate(
        "r", empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["hi"] >= x["lo"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["lo"].alias("lo"), F.greatest(F.try_element_at(acc, F.lit(-1))["hi"], x["hi"]).alias("hi")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    per = per.select("row", joined_up.alias("spans"), "items")
    out = found.select("row", "doc_id", "n_words").join(per, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its words, those inside benchmark windows, and the items these are from."""
    got = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
k AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
