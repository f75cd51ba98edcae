"""SimHash near-dedup (2): segment-popcount embedding, grid range-join, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.graph import components

from ._common import ids_only, materialize, ordered_id, read_table, small_batches
from ._words import NOT_SPACE, text_chunks

SHINGLE = 4
SEED = 42
MOST_BITS = 4
BANDS = 7
#: Fingerprints of a cell that one task compares; a larger cell is dealt over pairs of parts of this size.
CELL = 16384
#: Shingles that are hashed and counted at once.
BLOCK = 100_000
_PAIRS = np.uint64(0x5555555555555555)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text, whatever its length; zero without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for at, w in text_chunks(texts, NOT_SPACE):
        # the words of all texts, each with a space after it; a shingle is then a slice of that
        length = w.ends - w.starts
        spaced = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
        spaced[np.arange(len(spaced) - len(length)) + np.repeat(np.arange(len(length)), length)] = w.data[NOT_SPACE[w.data]]
        flat = spaced.tobytes()
        starts = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length + 1, out=starts[1:])
        first = w.first
        words = np.diff(first)
        n = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))  # shingles of each text
        for lo, hi in _runs(n):
            counts = np.zeros((hi - lo, 64), dtype=np.int64)
            for t0, t1, s0, s1 in _blocks(n[lo:hi]):
                # shingles s0.. of text t0 to those before s1 of text t1 - 1
                begin = np.concatenate([np.arange(first[lo + t] + (s0 if t == t0 else 0), first[lo + t] + (s1 if t == t1 - 1 else n[lo + t])) for t in range(t0, t1)])
                size = np.concatenate([np.full((s1 if t == t1 - 1 else n[lo + t]) - (s0 if t == t0 else 0), min(shingle, words[lo + t])) for t in range(t0, t1)])
                a, b = starts[begin].tolist(), (starts[begin + size] - 1).tolist()
                h = np.array([digest(flat[x:y], seed) for x, y in zip(a, b, strict=True)], dtype=np.uint64)
                bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                each = [(s1 if t == t1 - 1 else n[lo + t]) - (s0 if t == t0 else 0) for t in range(t0, t1)]
                cut = np.concatenate([[0], np.cumsum(each)[:-1]])
                some = np.flatnonzero(np.array(each) > 0)
                if len(some):
                    counts[t0 + some] += np.add.reduceat(bits, cut[some], axis=0, dtype=np.int64)
            over = 2 * counts > n[lo:hi, None]
            out[at + lo : at + hi] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _runs(n: np.ndarray, texts: int = 4096) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(n), texts):
        yield lo, min(len(n), lo + texts)


def _blocks(n: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int, int, int]]:
    """Texts t0 to t1 - 1 with about block shingles; one with more comes in several blocks, from s0 to before s1."""
    t = 0
    while t < len(n):
        if n[t] > block:
            for s in range(0, int(n[t]), block):
                yield t, t + 1, s, min(int(n[t]), s + block)
            t += 1
            continue
        total, end = int(n[t]), t + 1
        while end < len(n) and total + n[end] <= block:
            total += int(n[end])
            end += 1
        yield t, end, 0, int(n[end - 1])
        t = end


def document_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column("text"), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ids_only(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments, packed: two bits each, 0 to 2. |count - count| summed over the
    segments (the Manhattan distance of two embeddings) is at most the number of differing bits."""
    half = fp >> np.uint64(1)
    return ((half & fp & _PAIRS) << np.uint64(1)) | ((half ^ fp) & _PAIRS)


def embedded(fp: Column) -> Column:
    """embed() of a long column."""
    half, pairs = F.shiftrightunsigned(fp, 1), F.lit(int(_PAIRS))
    both, one = half.bitwiseAND(fp).bitwiseAND(pairs), half.bitwiseXOR(fp).bitwiseAND(pairs)
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of packed embeddings. Of counts 0, 1, 2 the larger minus the smaller is taken lane by
    lane: lanes are spread to four bits, so that a sum with a guard bit can't borrow from the next."""
    total = np.zeros(np.broadcast(a, b).shape, dtype=np.uint8)
    low, guard, one = np.uint64(0x3333333333333333), np.uint64(0x8888888888888888), np.uint64(0x1111111111111111)
    for shift in (np.uint64(0), np.uint64(2)):
        x, y = (a >> shift) & low, (b >> shift) & low
        d = (x | guard) - y  # 8 + x - y in each lane, so 6 to 10
        less = (~d & guard) >> np.uint64(3)  # 1 where x < y
        d = (d & np.uint64(0x7777777777777777)) ^ (less * np.uint64(7))  # |x - y|, less 1 where x < y
        total += np.bitwise_count(d & one) + 2 * np.bitwise_count(d & (one << np.uint64(1))) + np.bitwise_count(less)
    return total


def band_masks(bands: int = BANDS, most: int = MOST_BITS) -> list[int]:
    """Masks over packed embeddings. The 32 segments are dealt to `bands` bands; embeddings at distance `most` or less
    differ in at most `most` bands, so they agree in bands - most of them: one mask for each choice of those."""
    if bands <= most:
        raise ValueError("more bands than differing bits are needed")
    cut = [round(i * 32 / bands) for i in range(bands + 1)]
    band = [sum(3 << (2 * s) for s in range(cut[i], cut[i + 1])) for i in range(bands)]
    return [sum(c) for c in combinations(band, bands - most)]


def forest(fp: np.ndarray, most: int = MOST_BITS, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links of a cell connect: a spanning forest, a star for each component.

    fp: distinct fingerprints of one cell. They are put in order of their bit count, and each is compared with those
    in a range of `most` above its own (a bit count is the Manhattan distance to zero, so others are too far); then
    comes the Manhattan distance of the embeddings, and what is left is checked bit by bit.
    """
    ones = np.bitwise_count(fp)
    order = np.lexsort((fp, ones))
    fp, ones = fp[order], ones[order]
    e = embed(fp)
    top = np.searchsorted(ones, ones + most, "right")
    root = np.arange(len(fp))
    for lo in range(0, len(fp), block):
        hi = min(lo + block, len(fp))
        for c in range(lo, int(top[hi - 1]), 8192):
            d = min(c + 8192, int(top[hi - 1]))
            near = manhattan(e[lo:hi, None], e[None, c:d]) <= most if d - c > 64 else np.ones((hi - lo, d - c), dtype=bool)
            x, y = np.nonzero(near & (np.bitwise_count(fp[lo:hi, None] ^ fp[None, c:d]) <= most))
            x, y = x + lo, y + c
            keep = x < y
            _union(root, x[keep], y[keep])
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child], fp[root[child]]


def _union(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x[i] and y[i]; root[i] is the smallest index of i's set before and after."""
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:  # point everything at its root
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _cells(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(whole, columns) of runs of equal keys, over the batches of a partition that is sorted by its keys.

    The last column is fp, the others are keys. Where whole is set, the columns hold complete runs; else they are a
    piece of one run of over most_rows rows, of which no more than a batch and most_rows rows are held."""
    held: list[list[np.ndarray]] = []
    key: tuple | None = None
    size, large = 0, False

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        n = len(cols[-1])
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for k in cols[:-1]:
            change[1:] |= k[1:] != k[:-1]
        change[0] = key is not None and any(k[0] != v for k, v in zip(cols[:-1], key, strict=True))
        cut = np.flatnonzero(change)  # where runs start, other than the held one
        if len(cut):
            start, last = 0, int(cut[-1])
            if large:
                start = int(cut[0])
                if start:
                    yield False, [c[:start] for c in cols]
            if held or last > start:
                held.append([c[start:last] for c in cols])
                yield True, joined()
            held, size, large = [[c[last:] for c in cols]], n - last, False
        else:
            held.append(cols)
            size += n
        key = tuple(c[-1] for c in cols[:-1])
        if large or size > most_rows:
            large = True
            yield False, joined()
            held, size = [], 0
    if held:
        yield True, joined()


def _chunk_links(key: np.ndarray, fp: np.ndarray, most: int, few: int = 8, keys: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the links within each run of equal key (and keys) connect."""
    change = np.ones(len(fp), dtype=bool)
    change[1:] = key[1:] != key[:-1]
    for k in keys or ():
        change[1:] |= k[1:] != k[:-1]
    cut = np.append(np.flatnonzero(change), len(fp))
    length = np.diff(cut)
    # runs of a few: all at once, each row against the next, the one after next, and so on
    own = np.repeat(np.arange(len(length)), length)
    at = np.flatnonzero((length > 1)[own] & (length <= few)[own])
    run, f = own[at], fp[at]
    e = embed(f)
    for d in range(1, few):
        x = np.flatnonzero(run[d:] == run[:-d])
        x = x[manhattan(e[x], e[x + d]) <= most]
        x = x[np.bitwise_count(f[x] ^ f[x + d]) <= most]
        if len(x):
            yield f[x], f[x + d]
    for i in np.flatnonzero(length > few):
        a, b = forest(fp[cut[i] : cut[i + 1]], most)
        if len(a):
            yield a, b


def fingerprint_links(fps: DataFrame, most: int = MOST_BITS, bands: int = BANDS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in fps (column fp) that connect all within `most` bits.

    Every pair within `most` bits shares a grid cell, that is, the segment counts of bands - most bands, and is
    compared there. Of the links of a cell a spanning forest is returned: fewer rows than members, however many pairs
    link (cells of up to 8 return their links). A cell of over `cell` fingerprints is dealt by their hash over parts,
    and each pair of parts is a task of its own; so no cell, bucket or partner count is capped.
    """
    masks = band_masks(bands, most)
    counts = embedded(F.col("fp"))
    keys = F.array(*[F.xxhash64(F.lit(i), counts.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    grid = fps.select(F.explode(keys).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    names = ["a", "b", "large"]

    def rows(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), large))], names)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the cells, and (key, fp) of the members of large cells for the second pass."""
        for whole, (key, fp) in _cells(batches, cell):
            fp = fp.view(np.uint64)
            if not whole:
                yield rows(key, fp, True)
                continue
            cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            big = np.repeat(np.diff(cut) > cell, np.diff(cut))
            if big.any():
                yield rows(key[big], fp[big], True)
            for a, b in _chunk_links(key[~big], fp[~big], most):
                yield rows(a, b, False)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _cells(batches, 1 << 62):
            for a, b in _chunk_links(cols[0], cols[-1].view(np.uint64), most, keys=cols[1:-1]):
                yield rows(a, b, False)

    found = materialize(grid.mapInArrow(first_pass, "a long, b long, large boolean"))
    links = found.filter("NOT large").select("a", "b")
    large = found.filter("large").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not large.isEmpty():
        parts = materialize(large.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(cell)).cast("int").alias("parts")))
        large = large.join(parts, "key")
        part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = large.select("key", part.alias("part"), other.alias("other"), "fp")
        dealt = dealt.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "fp")
        dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        links = links.unionByName(materialize(dealt.mapInArrow(second_pass, "a long, b long, large boolean")).select("a", "b"))
    return links.distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = MOST_BITS, bands: int = BANDS, cell: int = CELL) -> DataFrame:
    """The near-duplicate component of each row of docs: doc_id, fp (signed long), component_id.

    docs: doc_id, text and any other columns, which are ignored. Equal fingerprints are one node, so copies cost
    nothing; links between nodes are found by fingerprint_links and joined to components, whose id is the smallest
    doc_id in them. A hot fingerprint meets only partial aggregates and a join of two plain exchanges, which the
    adaptive skew join splits.

    Null or empty text, or only blanks: fingerprint zero, linked like any other. Null doc_id sorts last, and is the
    component's id only if it has no other. Repeated rows each return a row. Empty table: no rows.
    More bands make cells smaller at the price of more cells: 7 suit some 10**8 different texts, 9 some 10**10.
    """
    own = materialize(document_fingerprints(docs, shingle, seed))
    nodes = materialize(own.groupBy("fp").agg(F.min(ordered_id(F.col("doc_id"))).alias("of")))
    links = fingerprint_links(nodes.select("fp"), most, bands, cell)
    comp = components(links).withColumnRenamed("component", "label")  # only nodes with links
    named = nodes.join(comp, nodes["fp"] == comp["node"], "inner").select("fp", "of", "label")
    least = materialize(named.groupBy("label").agg(F.min("of").alias("of")))
    named = materialize(named.select("fp", "label").join(least, "label").select("fp", F.col("of")))
    whole = materialize(nodes.join(named.select(F.col("fp").alias("f"), F.col("of").alias("least")), F.col("fp") == F.col("f"), "left").select("fp", F.coalesce("least", "of").getField("id").alias("component_id")))
    return own.join(whole, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its fingerprint and the smallest doc_id it is linked to, over any number of links."""
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
