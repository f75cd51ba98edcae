"""Mixing sources to target weights (7): Pfair release times and deadlines, earliest deadline first. Rows are placed by
DataFrame functions only; the driver deals the slots to the sources' blocks, of which there are some MOST_BLOCKS at most."""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ._common import bounded_broadcast, materialize, read_table

#: Documents of a source that are one block, at least. Of more than BLOCK * MOST_BLOCKS documents blocks are larger, so
#: that the driver's part of the work stays the same: a heap step and 8 bytes a block.
BLOCK = 16
MOST_BLOCKS = 1 << 20
#: Weights are rounded to multiples of 2^-FINE.
FINE = 36
#: Slots of which a source without a weight gets one, where there is such a source; then weights are rounded to multiples
#: of 1 / PERIOD. With many sources it is longer.
PERIOD = 1000
#: Blocks whose slots go to the executors as one row.
PART = 1000
#: Target weights, where none are given: a source's documents to this power, which lifts the small ones.
TEMPER = 0.7
#: Documents of one source that are put in order together.
CHUNK = 2_000
#: Bytes of text of a part of mix_in_order(), about; and parts, at most.
PART_BYTES = 128 << 20
MOST_PARTS = 1 << 16


def shares_of(weights: list[float], slots: int) -> list[int]:
    """Weights as whole shares of so many slots, by largest remainders. Who would get less than one gets one, and only
    for these the others give something. Without any positive weight all are alike."""
    if not sum(weights) > 0:
        weights = [1.0] * len(weights)
    least: set[int] = set()
    while True:
        total = sum(w for i, w in enumerate(weights) if i not in least)
        x = {i: w / total * (slots - len(least)) for i, w in enumerate(weights) if i not in least}
        under = {i for i in x if x[i] < 1}
        if not under:
            break
        least |= under
    out = [1 if i in least else int(x[i]) for i in range(len(weights))]
    for i in sorted(x, key=lambda i: int(x[i]) - x[i])[: slots - sum(out)]:
        out[i] += 1
    return out


def earliest_deadline_first(shares: list[int], slots: int, blocks: list[int]) -> list[array]:
    """The slot of each source's each block. Block k may run from slot floor(k * slots / share) on and must be over by
    ceil((k + 1) * slots / share); in each slot the block with the earliest deadline of those released runs, ties by
    source. As the shares add up to the slots at most, every block meets its window. Blocks are in absolute numbers:
    nothing is rounded to a period."""
    out, t = [array("q") for _ in shares], 0
    pending, ready = [(0, i) for i, n in enumerate(blocks) if n], []
    while pending or ready:
        if not ready:
            t = max(t, pending[0][0])
        while pending and pending[0][0] <= t:
            i = heappop(pending)[1]
            heappush(ready, (-(-(len(out[i]) + 1) * slots // shares[i]), i))
        i = heappop(ready)[1]
        out[i].append(t)
        if len(out[i]) < blocks[i]:
            heappush(pending, (len(out[i]) * slots // shares[i], i))
        t += 1
    return out


def _sorted(rows: list, key: str) -> list:
    """By a source, null first, as Spark sorts."""
    return sorted(rows, key=lambda r: (r[key] is not None, r[key]) if r[key] is not None else (False,))


def schedule(spark: SparkSession, sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """The slots of one period for sources (source, weight): source, nth (block of the source in the period, from
    0), share (its blocks in a period), slots (of a period), release, deadline and slot.

    Weights are rounded to share / slots, at least one block each. At any time each source has had less than one block
    more or less than its share.

    The result has `slots` rows: the period, or four times the number of sources if that is more."""
    found = _checked(sources.select("source", F.col("weight").cast("double").alias("weight")).collect(), "source")
    slots = max(period, 4 * len(found))
    shares = shares_of([r.weight or 0.0 for r in found], slots) if found else []
    rows = [(r.source, k, q, slots, k * slots // q, -(-(k + 1) * slots // q), slot) for r, q, at in zip(found, shares, earliest_deadline_first(shares, slots, shares), strict=True) for k, slot in enumerate(at)]
    kinds = [StructField(n, LongType()) for n in ("nth", "share", "slots", "release", "deadline", "slot")]
    return spark.createDataFrame(rows, StructType([StructField("source", sources.schema["source"].dataType), *kinds]))


def _checked(rows: list, key: str) -> list:
    """Rows (key, weight) in order. Each source once, and weights that are numbers from 0 on; null is 0."""
    for r in rows:
        if r.weight is not None and not 0 <= r.weight < math.inf:
            raise ValueError(f"the weight of source {r[key]!r} is {r.weight}")
    if len({r[key] for r in rows}) < len(rows):
        raise ValueError("a source has several weights")
    return _sorted(rows, key)


class _Plan:
    """The slots of all blocks: sources (in order), shares of `slots`, run (the slots of each source's blocks), block."""

    def __init__(self, sources: DataFrame, block: int, period: int):
        self.kind = sources.schema["source"].dataType
        found = _sorted(sources.select("source", "n", F.col("weight").cast("double").alias("weight")).collect(), "source")
        self.block = max(block, -(-sum(r.n for r in found) // MOST_BLOCKS))
        weights = [r.weight or 0.0 for r in found]
        self.slots = 1 << FINE if all(w > 0 for w in weights) else max(period, 4 * len(found))
        self.sources = [r.source for r in found]
        self.shares = shares_of(weights, self.slots) if found else []
        self.run = earliest_deadline_first(self.shares, self.slots, [-(-r.n // self.block) for r in found])

    def table(self, spark: SparkSession) -> DataFrame:
        """of, share, part and at (the slots of PART blocks)."""
        rows = [(of, q, k // PART, at[k : k + PART].tolist()) for of, q, at in zip(self.sources, self.shares, self.run, strict=True) for k in range(0, len(at), PART)]
        kinds = [StructField("of", self.kind), StructField("share", LongType()), StructField("part", LongType()), StructField("at", ArrayType(LongType()))]
        return materialize(spark.createDataFrame(rows, StructType(kinds), verifySchema=False))

    def placed(self, ranked: DataFrame, table: DataFrame) -> DataFrame:
        """ranked (source, rank, ...) with block, share, slot and place."""
        x = ranked.withColumn("block", F.expr(f"rank div {self.block}")).withColumn("of_part", F.expr(f"block div {PART}"))
        x = x.join(bounded_broadcast(table, 8 * PART + 128), F.col("source").eqNullSafe(F.col("of")) & (F.col("of_part") == F.col("part")))
        slot, place = F.expr(f"at[cast(block % {PART} AS int)]"), F.expr(f"cast(rank % {self.block} AS int)")
        return x.withColumns({"slot": slot, "place": place}).drop("of", "part", "at", "of_part")


def _weighted(docs: DataFrame, weights: DataFrame | None, temper: float) -> tuple[DataFrame, int]:
    """(source, n, weight) of the sources of docs, and all rows."""
    sizes = materialize(docs.groupBy("source").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        return sizes.select("source", "n", F.pow("n", F.lit(temper)).alias("weight")), total
    rows = _checked(weights.select("source", F.col("weight").cast("double").alias("weight")).collect(), "source")
    given = docs.sparkSession.createDataFrame([(r.source, r.weight) for r in rows], StructType([StructField("of", weights.schema["source"].dataType), StructField("weight", DoubleType())]))
    return sizes.join(given, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight")), total


def _keys(tie: Column | None) -> dict[str, Column]:
    """The columns by which a source's rows are put in order: a hash first."""
    tie = F.lit(0).cast("long") if tie is None else tie
    return {"h": F.xxhash64("doc_id", tie, F.lit("mix")), "id": F.col("doc_id"), "tie": tie}


_ORDER = ("h", "id", "tie")


def _ranked(rows: DataFrame, total: int, chunk: int) -> DataFrame:
    """rows (source, h, id, tie, ...) with rank (within the source, from 0) and first (the rank of the first equal row)."""
    bits = max(1, (max(total, 1) // chunk).bit_length())
    rows = rows.withColumn("chunk", F.shiftright("h", 64 - bits))  # with the sign: in the order of the hash
    counts = rows.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    # rows before each chunk: before its span of chunks, and within the span; both windows see about the root of the chunks
    counts = materialize(counts.withColumn("span", F.shiftright("chunk", bits // 2)))
    spans = counts.groupBy("source", "span").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("source").alias("s1"), F.col("span").alias("p1"), before.alias("before_span"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("source", "span").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.withColumn("within", within).join(spans, F.col("source").eqNullSafe(F.col("s1")) & (F.col("span") == F.col("p1")))
    offsets = materialize(parts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.col("before_span") + F.col("within")).alias("before")))
    own = Window.partitionBy("source", "chunk").orderBy(*_ORDER)
    ranked = rows.withColumns({"nth": F.row_number().over(own), "tied": F.rank().over(own)})
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return ranked.withColumns({"rank": F.col("before") + F.col("nth") - 1, "first": F.col("before") + F.col("tied") - 1}).drop("s", "c", "before", "nth", "tied", "chunk")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temper: float = TEMPER, block: int = BLOCK, period: int = PERIOD, chunk: int = CHUNK, keep: tuple[str, ...] = ("doc_id", "source"), tie: Column | None = None) -> DataFrame:
    """Every row of docs with its place in the mix: kept (a struct of the columns named in keep), block (number within
    the source), release, deadline, slot, place (within the block). Order by slot, place to read the mix.

    docs: doc_id, source and others. weights: source, weight (0 or more, each source once, else it is refused; a source
    without a weight or with 0 gets none of the others' share but the least, one block a period, and all shares are
    then whole blocks of a period; without any positive weight all are alike); or None for documents ** temper. A
    source's documents are put in a fixed shuffled order (by a hash of doc_id, and of tie, if given) and cut into blocks
    of `block`, or more where there would be over MOST_BLOCKS. Up to the slot at which the first source runs out, each
    source's blocks so far differ from its weight times the slots by less than one, however many slots or sources there
    are. Then its share of the slots stays empty, and the others go on at their own rates; no row is dropped or repeated.

    A source may hold any share of the rows: it is numbered in chunks of about `chunk` rows by ranges of the hash, and
    only the chunks' counts are summed up. Null source is a source of its own; null doc_id is ordered like any other
    id, but many of them need a tie (such as a hash of the text) to be dealt over chunks; rows that repeat a doc_id
    each have a place. Empty table: no rows."""
    wanted, total = _weighted(docs, weights, temper)
    plan = _Plan(wanted, block, period)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("source"), *[c.alias(n) for n, c in _keys(tie).items()])
    out = plan.placed(_ranked(rows, total, chunk), plan.table(docs.sparkSession))
    release, deadline = F.expr(f"block * {plan.slots}L div share"), F.expr(f"((block + 1) * {plan.slots}L + share - 1) div share")
    return out.select("kept", "block", release.alias("release"), deadline.alias("deadline"), "slot", "place")


def mix_in_order(docs: DataFrame, weights: DataFrame | None = None, temper: float = TEMPER, block: int = BLOCK, period: int = PERIOD, chunk: int = CHUNK, tie: Column | None = None, parts: int | None = None) -> DataFrame:
    """The rows of docs in the order of the mix (as mix_sources() places them): partitions, and rows in them, follow the
    slots, so a table written from this is read in that order. Parameters and cases as there; text in docs.

    Whole rows move once. First narrow rows are placed, and of the blocks with which each source begins each part
    (so many blocks for each) the first row is noted: one for each source and part, no more than there are blocks. Whole
    rows then find their part by comparing with these in their own range of hashes (a table of some 2^16 rows that is
    broadcast), move there, and are numbered there again. `parts` defaults to the text's bytes / PART_BYTES, four for
    each core at least. A row that stands several times stays together, even across a part's end."""
    spark = docs.sparkSession
    wanted, total = _weighted(docs, weights, temper)
    if not total:
        return docs
    plan = _Plan(wanted, block, period)
    table = plan.table(spark)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = min(MOST_PARTS, max(4 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)))
    # where parts begin, in slots: so many blocks each
    every = sorted(x for at in plan.run for x in at)
    begin = [every[i * len(every) // parts] for i in range(parts)]
    starts = []
    for of, at in zip(plan.sources, plan.run, strict=True):
        last = -1
        for k, slot in enumerate(at):
            p = bisect_right(begin, slot) - 1
            if p != last:
                starts.append((of, k, p))
                last = p
    kinds = [StructField("s", plan.kind), StructField("k", LongType()), StructField("p", LongType())]
    keys = _keys(tie)
    narrow = plan.placed(_ranked(docs.select("source", *[c.alias(n) for n, c in keys.items()]), total, chunk), table).filter("place = 0")
    noted = narrow.join(F.broadcast(spark.createDataFrame(starts, StructType(kinds))), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    found = noted.select("source", *_ORDER, "p", "first").collect()  # no more than there are blocks
    bits = max(1, ((1 << 16) // len(plan.sources)).bit_length() - 1)
    splits: dict = {}
    for r in sorted(found, key=lambda r: r.p):
        splits.setdefault(r.source, []).append((r.h >> (64 - bits), (*(r[c] for c in _ORDER), r.p, r.first)))
    rows = []
    for of in plan.sources:
        i, j = 0, 1  # the last split before the cell (or the first of all), and the first one behind it
        for cell in range(-(1 << bits - 1), 1 << bits - 1):
            while j < len(splits[of]) and splits[of][j][0] <= cell:
                j += 1
            rows.append((of, cell, [x for _, x in splits[of][i:j]]))
            i = j - 1
    id_type = docs.schema["doc_id"].dataType
    split = StructType([StructField("h", LongType()), StructField("id", id_type), StructField("tie", LongType()), StructField("p", LongType()), StructField("first", LongType())])
    lookup = spark.createDataFrame(rows, StructType([StructField("s", plan.kind), StructField("cell", LongType()), StructField("splits", ArrayType(split))]))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("source"), *[c.alias(n) for n, c in keys.items()])
    whole = whole.withColumn("own", F.shiftright("h", 64 - bits)).join(F.broadcast(lookup), F.col("source").eqNullSafe(F.col("s")) & (F.col("own") == F.col("cell")))
    # the last split that isn't after the row; rows before a cell's first split belong to the split before the cell
    key = F.struct(*_ORDER)
    after = F.filter("splits", lambda x: F.struct(*[x[c].alias(c) for c in _ORDER]) <= key)
    whole = whole.withColumn("at", F.coalesce(F.try_element_at(after, F.lit(-1)), F.element_at("splits", 1)))
    whole = whole.select("kept", "source", *_ORDER, F.col("at.p").cast("int").alias("p"), F.col("at.first").alias("first"))
    moved = whole.repartitionById(parts, "p")
    nth = F.row_number().over(Window.partitionBy("p", "source").orderBy(*_ORDER))
    ranked = moved.withColumn("rank", F.col("first") + nth - 1)
    return plan.placed(ranked, table).sortWithinPartitions("slot", "place").select("kept.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its source, block, and where the block may and does run."""
    got = mix_sources(read_table(spark, sf_dir, "documents"))
    return got.select("kept.*", "block", "release", "deadline", "slot", "place")
