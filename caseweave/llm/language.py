"""Language ID (4): multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ids_only, read_table, small_batches

#: Lengths of n-grams, and the bits of the hash they share.
GRAMS = (1, 2, 3)
BITS = 16
#: Added to each count.
SMOOTH = 0.5
#: Characters that are worked on at once; a longer text comes in pieces.
CHUNK = 400_000
UNKNOWN = "und"
_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _pieces(texts: list[str], pad: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text of each piece, code points, bounds of the pieces): pad spaces end each text; a piece of a longer text
    also holds the pad characters that follow it, so that no n-gram is lost or counted twice."""
    owner, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(len(t), 1), CHUNK):
            parts.append(t[lo : lo + CHUNK + pad].ljust(min(CHUNK, len(t) - lo) + pad))
            owner.append(i)
            size += len(parts[-1])
            if size >= CHUNK:
                yield owner, *_points(parts)
                owner, parts, size = [], [], 0
    if parts:
        yield owner, *_points(parts)


def _points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def features(texts: list[str]) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """(text of each piece, for each n the buckets of its n-grams and where those of each piece begin, and end).

    Texts are lower-cased; characters that aren't letters count as a space; n-grams without a letter don't count."""
    pad = max(GRAMS) - 1
    for owner, points, bounds in _pieces([t.lower() for t in texts], pad):
        letter = _letters()[points]
        c = np.where(letter, points, np.uint32(32))
        own = np.ones(len(c), dtype=bool)  # not padding
        for j in range(1, pad + 1):
            own[bounds[1:] - j] = False
        out, h, some = [], np.zeros(len(c), dtype=np.uint32), np.zeros(len(c), dtype=bool)
        for n in range(1, max(GRAMS) + 1):
            m = len(c) - n + 1
            h, some = h[:m] + c[n - 1 :] * _MULTIPLIERS[n - 1], some[:m] | letter[n - 1 :]
            if n not in GRAMS:
                continue
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x27D4EB2F)
            at = np.flatnonzero(some & own[:m])
            out.append((((mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - BITS))[at], np.searchsorted(at, bounds)))
        yield owner, out


class Model:
    """Languages, and the logarithm of each bucket's probability (a row for each language)."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        counts = counts + SMOOTH
        self.log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.prior = np.log(np.maximum(documents, 1) / max(1, documents.sum()))
        #: The least fit (see judge) of a text in each language: none, until calibrate() sets it.
        self.least_fit = np.full(len(languages), -np.inf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and the score: the first two of judge()."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, the score, and the mean log-likelihood of its longest n-grams in that language
        (0 without a letter), which tells whether the language fits at all. For the score, log-likelihoods are divided by the square root of the number of
        n-grams: neighbouring n-grams overlap, so they aren't independent evidence, and the plain posterior of any
        longer text would be 1."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        longest, n_longest = np.zeros_like(total), np.zeros_like(n)
        for owner, grams in features(texts):
            for size, (buckets, cut) in zip(GRAMS, grams, strict=True):
                np.add.at(n, owner, np.diff(cut))
                if not len(buckets):
                    continue
                sums = np.zeros((len(owner), len(self.languages)))
                some = np.flatnonzero(np.diff(cut) > 0)
                for i, row in enumerate(self.log_p):
                    sums[some, i] = np.add.reduceat(row[buckets], cut[some], dtype=np.float64)
                np.add.at(total, owner, sums)
                if size == max(GRAMS):
                    np.add.at(longest, owner, sums)
                    np.add.at(n_longest, owner, np.diff(cut))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total += self.prior
        z = total / np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        score = np.where(n > 0, p[np.arange(len(best)), best], 0.0)
        fit = longest[np.arange(len(best)), best] / np.maximum(n_longest, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score, fit


def _labelled(docs: DataFrame) -> DataFrame:
    """All documents with a label and a text (doc_id, text, lang)."""
    return ids_only(docs, ("doc_id", "text", "lang")).filter("lang IS NOT NULL AND text IS NOT NULL")


def calibrate(model: Model, held: DataFrame) -> Model:
    """The model with its least fits set by all labelled documents it hasn't seen (doc_id, text, lang):
    halfway between the mean fit of a language's documents and that of n-grams drawn at random, which fall into any
    bucket. A language without such a document has no least fit."""
    if not model.languages:
        return model
    shared = held.sparkSession.sparkContext.broadcast(model)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, _, fit = shared.value.judge(b.column("text").to_pylist())
            same = [i for i, (x, y) in enumerate(zip(lang, b.column("lang").to_pylist(), strict=True)) if x == y]
            yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in same], pa.string()), pa.array(fit[same], pa.float64())], ["lang", "fit"])

    small_batches(held.sparkSession)
    typical = {r.lang: r.fit for r in _labelled(held).select("lang", "text").mapInArrow(fits, "lang string, fit double").groupBy("lang").agg(F.avg("fit").alias("fit")).collect()}
    chance = model.log_p.mean(axis=1, dtype=np.float64)
    model.least_fit = np.array([(typical[x] + c) / 2 if x in typical else -np.inf for x, c in zip(model.languages, chance, strict=True)])
    return model


def fit(labelled: DataFrame) -> Model:
    """A model of labelled documents (doc_id, text, lang; null lang is left out).

    Fitted on all of them. Its counts, one row for each language and bucket, are summed by the executors before they
    come here."""
    spark = labelled.sparkSession
    chosen = _labelled(labelled)
    sizes = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BITS
        counts = np.zeros(len(languages) * size, dtype=np.int64)
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], dtype=np.int64)
            for owner, grams in features(b.column("text").to_pylist()):
                for buckets, cut in grams:
                    of = np.repeat(lang[owner], np.diff(cut))
                    counts += np.bincount(of * size + buckets, minlength=len(counts))
        some = np.flatnonzero(counts)
        for lo in range(0, len(some), 100_000):
            part = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["at", "n"])

    small_batches(spark)
    got = chosen.select("lang", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) << BITS)
    counts[got["at"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return Model(languages, counts.reshape(len(languages), -1), np.array([sizes[x] for x in languages]))


def predict_language(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns named in keep, lang_pred and score (by these or other names; with a third, also whether the language
    fits the text as well as the model's least fit asks) of each document (text; other columns aren't looked at).

    lang_pred is a language of the model, or und (score 0) for a text that is null or has no letter, and for every
    text if the model has no language. Ties go to the language that is first by name. Whole texts of any length are
    scored, in pieces. One pass, no shuffle; the model (languages x 65,536 floats) is broadcast. Repeated rows each
    return a row. Empty table: no rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = ids_only(docs, dict.fromkeys((*keep, "text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, fit = shared.value.judge([t or "" for t in b.column("text").to_pylist()])
            least = dict(zip(shared.value.languages, shared.value.least_fit.tolist(), strict=True))
            fits = [x in least and f >= least[x] for x, f in zip(lang, fit.tolist(), strict=True)]
            kept = [b.column(i) for i, c in enumerate(b.schema.names) if c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fits, pa.bool_())][: len(names)]], [*(c for c in b.schema.names if c in keep), *names])

    small_batches(spark)
    return rows.mapInArrow(run, ", ".join([fields, *(f"{n} {t}" for n, t in zip(names, ("string", "double", "boolean")))]))


def accepted(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of docs in a language of the model, with docs' own columns: not und, of a score of `least` or more,
    and one that fits (calibrate)."""
    found = predict_language(docs, model, tuple(docs.columns), ("__lang_pred", "__score", "__fits"))
    return found.filter((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least) & F.col("__fits")).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out() -> Column:
    """Every fourth document, by the CRC-32 of its id, is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it was held out, and the predicted language with a score."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
