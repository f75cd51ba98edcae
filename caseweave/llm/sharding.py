"""Sharding (9): extendible hashing with a byte limit. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_broadcast, materialize, read_table

#: Bytes of text of a shard.
LIMIT = 64 << 20
#: Bits of the first directory at most, and bits that each further round looks at.
FIRST_BITS = 18
MORE_BITS = 8


def shard_hash() -> Column:
    """The hash whose leading bits choose the shard: of the id and the text, so that null or repeated ids spread too."""
    return F.xxhash64("doc_id", "text", F.lit("shard"))


def _prefix(h: Column | str, bits: int) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(sizes: DataFrame, limit: int = LIMIT, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> list[tuple[int, DataFrame]]:
    """Rounds (bits, cells) of the directory for rows h, bytes: cells has prefix (of so many bits), shard_id, depth,
    shard_bytes, shard_docs, oversize, for all prefixes that are decided in that round.

    A bucket is a prefix of the hash. It is a shard if its bytes fit the limit, or if all its rows have one hash, so that no
    bit tells them apart (one document over the limit, or exact repeats: then oversize is set if they don't fit); else
    it splits on the next bit, and only it. A round sums the bytes of all prefixes of up to `bits` bits at once,
    from one partial aggregate; buckets still too large there go on to the next round, with only their own rows."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bits = min(first_bits, max(1, (total // limit).bit_length() + 3))
    start, rounds, open_rows = 0, [], sizes
    while True:
        cells = materialize(open_rows.groupBy(_prefix("h", bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        up = F.explode(F.sequence(F.lit(0), F.lit(bits - start))).alias("up")
        paths = cells.select("cell", "bytes", "docs", "lo", "hi", up).withColumn("depth", F.lit(bits) - F.col("up")).withColumn("p", F.expr("shiftrightunsigned(cell, up)"))
        nodes = materialize(paths.groupBy("depth", "p").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        ok = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
        parents = nodes.filter(~ok).select((F.col("depth") + 1).alias("d"), F.col("p").alias("q"))
        fits = nodes.filter(ok)
        # below a bucket that splits; or the first bits of all: in later rounds the bucket above is known to split
        shards = fits.filter(F.col("depth") == start).unionByName(fits.filter(F.col("depth") > start).join(parents, (F.col("depth") == F.col("d")) & (F.expr("shiftrightunsigned(p, 1)") == F.col("q")), "left_semi"))
        named = shards.select(
            F.col("depth").alias("sd"), F.col("p").alias("sp"), "depth",
            F.when(F.col("depth") == 0, "-").otherwise(F.expr("lpad(bin(p), depth, '0')")).alias("shard_id"),
            F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), (F.col("bytes") > limit).alias("oversize"),
        )
        found = paths.select("cell", F.col("depth").alias("d"), "p").join(named, (F.col("d") == F.col("sd")) & (F.col("p") == F.col("sp")))
        found = materialize(found.select(F.col("cell").alias("prefix"), "shard_id", "depth", "shard_bytes", "shard_docs", "oversize"))
        rounds.append((bits, found))
        open_cells = cells.join(found, F.col("cell") == F.col("prefix"), "left_anti").select("cell")
        if bits == 64 or open_cells.isEmpty():
            return rounds
        open_rows = materialize(open_rows.join(open_cells, _prefix("h", bits) == F.col("cell"), "left_semi"))
        start, bits = bits, min(64, bits + more_bits)


def shard_documents(docs: DataFrame, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",), first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> DataFrame:
    """Every row of docs with its shard: kept (a struct of the columns named in keep), shard_id (the leading bits of
    its hash, `-` for none), depth (their number), shard_bytes, shard_docs, oversize.

    docs: doc_id, text and others. Every shard's texts fit `limit` bytes of UTF-8 together, but for one that no bit
    can split: a single document over the limit, or repeats of one id and text; it says oversize. A row's shard only
    depends on the rows whose hashes begin alike, so shards don't move when a bucket elsewhere splits.

    Null text has no bytes; null ids are fine; no shard is made for an empty range of hashes. Empty table: no rows.
    The directory of a round is counted, and broadcast only if small, else joined by shuffle."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), shard_hash().alias("h"))
    sizes = materialize(docs.select(shard_hash().alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    names = ("shard_id", "depth", "shard_bytes", "shard_docs", "oversize")
    for i, (bits, cells) in enumerate(directory(sizes, limit, first_bits, more_bits)):
        side = bounded_broadcast(cells.select(F.col("prefix").alias(f"p{i}"), *[F.col(n).alias(f"{n}{i}") for n in names]), 128)
        rows = rows.join(side, _prefix("h", bits) == F.col(f"p{i}"), "left")
        rows = rows.select("kept", "h", *[F.coalesce(n, f"{n}{i}").alias(n) if i else F.col(f"{n}{i}").alias(n) for n in names])
    return rows.drop("h")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its shard, and how large that is."""
    return shard_documents(read_table(spark, sf_dir, "documents")).select("kept.*", "shard_id", "depth", "shard_bytes", "shard_docs", "oversize")
