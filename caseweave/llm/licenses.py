"""License scans (5): exact set-similarity join of text blocks with license templates, and exact phrases."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ids_only, read_table, small_batches
from ._words import IN_WORD, Words, text_chunks

# Phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of public licenses, as their authors print them, by paragraph or opening sentence.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Share of a template's distinct words that a block must have.
CONTAINMENT = 0.8
#: A block is this many times a template's words, rounded up; every run of so many consecutive words is one.
SLACK = 1.25


def _split(text: str) -> list[bytes]:
    _, w = next(iter(text_chunks(pa.array([text]), IN_WORD)))
    return [w.word(i) for i in range(len(w.starts))]


def _hash_of(words: list[bytes]) -> np.ndarray:
    """The hash of each word, as Words.hashes() gives it."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    _, w = next(iter(text_chunks(pa.array([b" ".join(words).decode()]), IN_WORD)))
    return w.hashes()


class _Vocabulary:
    """Finds which words of a text are among a few, exactly."""

    def __init__(self, words: list[bytes]):
        self.words = words
        h = _hash_of(words)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def find(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions over all texts, numbers of the words there)."""
        if not len(self.words) or not len(h):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        p = np.flatnonzero(self.sorted[at] == h)
        of = self.order[at[p]]
        size = np.array([len(x) for x in self.words])
        same = (w.ends - w.starts)[p] == size[of]
        p, of = p[same], of[same]
        same = np.fromiter((w.word(i) == self.words[j] for i, j in zip(p.tolist(), of.tolist(), strict=True)), dtype=bool, count=len(p))
        return p[same], of[same]


def template_frequencies(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> Counter:
    """In how many documents each template word stands: one pass over all texts, counts of a few words come back."""
    vocabulary = sorted({x for _, t in templates for x in _split(t)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = _Vocabulary(vocabulary), np.zeros(len(vocabulary), dtype=np.int64)
        for b in batches:
            for _, w in text_chunks(b.column("text"), IN_WORD):
                p, of = found.find(w, w.hashes())
                pairs = np.unique(w.owner()[p] * len(vocabulary) + of) if len(p) else p
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in vocabulary]), pa.array(total)], ["word", "n"])

    small_batches(docs.sparkSession)
    rows = ids_only(docs, ("text",)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return Counter({r.word.encode(): r.n for r in rows})


class _Template:
    def __init__(self, label: str, text: str, frequency: Counter, containment: float, slack: float):
        words = _split(text)
        if not words:
            raise ValueError(f"template {label} has no words")
        self.label = label
        self.tokens = sorted(set(words), key=lambda x: (frequency[x], x))  # rarest first, over the whole corpus
        self.rank = {x: i for i, x in enumerate(self.tokens)}
        self.need = max(1, math.ceil(containment * len(self.tokens) - 1e-9))
        self.prefix = len(self.tokens) - self.need + 1  # a block with `need` tokens has one of these
        self.block = math.ceil(slack * len(words))

    def blocks(self, at: list[int], rank: list[int]) -> list[tuple[int, int, int]]:
        """(first word, last word, distinct tokens) of the text's blocks, from its tokens by ascending position.

        From left to right: the first end at which a run of `block` words qualifies; of the runs that end there or up
        to `block` words on, the one with the most tokens (the first of them), without words at its edges that it has
        again or that are no tokens. The search goes on behind it, so every run that qualifies overlaps a block."""
        if len(set(rank)) < self.need or min(rank) >= self.prefix:  # length and prefix filters on the whole text
            return []
        near = self._near(at, rank)
        out, start = [], 0
        while start < len(at):
            inside, kinds, lo, best, until = [0] * len(self.tokens), 0, start, None, 1 << 62
            for hi in range(start, len(at)):
                p = at[hi]
                if p >= until:
                    break
                inside[rank[hi]] += 1
                kinds += inside[rank[hi]] == 1
                while at[lo] <= p - self.block:
                    inside[rank[lo]] -= 1
                    kinds -= inside[rank[lo]] == 0
                    lo += 1
                if near[hi] and kinds >= self.need and (best is None or kinds > best[2]):
                    until = p + self.block if best is None else until
                    best = lo, hi, kinds
            if best is None:
                break
            lo, hi, kinds = best
            while rank[lo] in rank[lo + 1 : hi + 1]:
                lo += 1
            out.append((at[lo], at[hi], kinds))
            start = hi + 1
        return out

    def _near(self, at: list[int], rank: list[int]) -> list[bool]:
        """Positional filter: whether a block that ends at each token can hold a prefix token."""
        out, last = [], -self.block
        for p, r in zip(at, rank, strict=True):
            last = p if r < self.prefix else last
            out.append(p - last < self.block)
        return out


def _index(made: list[_Template], vocabulary: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    """The join's index: for each word the templates that have it in their prefix; and each template's ranks by word."""
    number = {x: i for i, x in enumerate(vocabulary)}
    heads: list[list[int]] = [[] for _ in vocabulary]
    ranks = np.full((len(made), len(vocabulary)), -1, dtype=np.int64)
    for t, template in enumerate(made):
        for r, x in enumerate(template.tokens):
            ranks[t, number[x]] = r
            if r < template.prefix:
                heads[number[x]].append(t)
    return heads, ranks


def _resolved(found: list[tuple[int, int, int, int, float]]) -> list[bool]:
    """Whether each block (template, first, last, tokens, containment) is the best of those it overlaps by more than half
    of the shorter: the highest containment, then the most tokens, then the first template. Near-equal notices (a
    version, one more condition) match one text; only the best names it."""
    order = sorted(range(len(found)), key=lambda i: (-found[i][4], -found[i][3], found[i][0], found[i][1]))
    best, kept = [False] * len(found), []
    for i in order:
        _, a, z, _, _ = found[i]
        if all(2 * (min(z, y) - max(a, x) + 1) <= min(z - a, y - x) + 1 for x, y in kept):
            kept.append((a, z))
            best[i] = True
    return best


_BLOCK = "array<struct<label:string,first:long,last:long,containment:double,best:boolean>>"
_BLOCK_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64()), ("best", pa.bool_())]))


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: Sequence[tuple[str, str]] | None = None, containment: float = CONTAINMENT, slack: float = SLACK) -> DataFrame:
    """Licenses named or quoted in each whole text.

    Returns one row for each row of docs (doc_id, text; other columns are ignored): doc_id, n_words, starts (word
    positions of all places of the phrases, ascending), base_labels (of phrases), blocks (label, first and last word,
    containment, best), template_labels (of the best blocks), labels sorted and distinct, and score: 1 where a phrase
    stands, else the best containment of a block, else 0.

    Set-similarity join of text blocks with templates (label, notice; a label may have several): a run of `slack` times
    the template's words meets it if it has at least `containment` of its distinct words. Words are ordered by their
    document frequency, counted over all documents, rarest first. A text looks up its words in an index of all
    templates' prefixes (the rarest |T| - need + 1 words), and only templates found so are looked at (prefix), if the
    text has enough of their words (length), and only within reach of a prefix word (position). All blocks of all
    templates come back, apart from each other within a template; each run that qualifies overlaps one. Of blocks that
    overlap, the best one gives the label, so that a notice isn't also named by its near-equal siblings.

    Templates and phrases are parameters, a few kilobytes in all, and go to every task; no text is shuffled. Null or
    empty text: no words, no labels, score 0. Repeated rows each return a row. Empty table: no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    wanted = [(_split(p), label) for p, label in phrases.items()]
    frequency = template_frequencies(docs, templates)
    made = [_Template(label, t, frequency, containment, slack) for label, t in templates]
    vocabulary = sorted({x for t in made for x in t.tokens})
    prefixes, ranks = _index(made, vocabulary)
    heads = sorted({x for p, _ in wanted for x in p})
    kind = ids_only(docs, ("doc_id",)).schema[0].dataType.simpleString()
    lists = pa.list_(pa.string())

    def quoted(at: np.ndarray, of: np.ndarray) -> list[dict]:
        """The blocks of one text, from its template words' places and numbers."""
        words = np.unique(of)
        found = []
        for t in sorted({t for x in words.tolist() for t in prefixes[x]}):
            if np.count_nonzero(ranks[t, words] >= 0) < made[t].need:
                continue
            r = ranks[t, of]
            own = r >= 0
            found += [(t, a, z, n, n / len(made[t].tokens)) for a, z, n in made[t].blocks(at[own].tolist(), r[own].tolist())]
        best = _resolved(found)
        rows = [{"label": made[t].label, "first": a, "last": z, "containment": c, "best": b} for (t, a, z, _, c), b in zip(found, best, strict=True)]
        return sorted(rows, key=lambda x: (x["first"], x["last"], x["label"], x["containment"]))

    def scan(w: Words, found: _Vocabulary, named: _Vocabulary) -> list[tuple[list[int], list[str], list[dict]]]:
        h = w.hashes()
        p, of = found.find(w, h)
        q, q_of = named.find(w, h)
        cuts, q_cuts = np.searchsorted(p, w.first), np.searchsorted(q, w.first)
        out = []
        for i in range(len(w.bounds) - 1):
            starts, base = [], set()
            if q_cuts[i + 1] > q_cuts[i]:
                there = dict(zip(q[q_cuts[i] : q_cuts[i + 1]].tolist(), (heads[x] for x in q_of[q_cuts[i] : q_cuts[i + 1]]), strict=True))
                for words, label in wanted:
                    for s in there:
                        if there[s] == words[0] and s + len(words) <= w.first[i + 1] and all(there.get(s + j) == x for j, x in enumerate(words)):
                            starts.append(s - int(w.first[i]))
                            base.add(label)
            blocks = quoted(p[cuts[i] : cuts[i + 1]] - w.first[i], of[cuts[i] : cuts[i + 1]]) if cuts[i + 1] > cuts[i] else []
            out.append((sorted(starts), sorted(base), blocks))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, named = _Vocabulary(vocabulary), _Vocabulary(heads)
        for b in batches:
            rows, words = [], []
            for _, w in text_chunks(b.column("text"), IN_WORD):
                rows += scan(w, found, named)
                words.append(np.diff(w.first))
            n = np.concatenate(words) if words else np.zeros(0, dtype=np.int64)
            labels = [sorted({x["label"] for x in r[2] if x["best"]}) for r in rows]
            score = [1.0 if r[1] else max((x["containment"] for x in r[2]), default=0.0) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], lists), pa.array([r[2] for r in rows], _BLOCK_TYPE), pa.array(labels, lists), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "starts", "base_labels", "blocks", "template_labels", "score"],
            )

    return ids_only(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, starts array<long>, base_labels array<string>, blocks {_BLOCK}, template_labels array<string>, score double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its words, places and labels of the phrases, labels of the templates too."""
    got = license_scan(read_table(spark, sf_dir, "documents"))
    both = F.array_sort(F.array_union("base_labels", "template_labels"))
    return got.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score", F.to_json("blocks").alias("blocks"),
    )
