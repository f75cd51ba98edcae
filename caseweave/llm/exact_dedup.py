"""Exact dedup (1): progressive refinement by length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SALTS, SIEVE_BITS, Sieve, ids_only, materialize, ordered_id, read_table

#: The characters that don't count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
#: Code points of the normalised text under the prefix hash.
PREFIX = 256
def normalised(text: Column) -> Column:
    """Null as empty, without blanks."""
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, most_bits: int = SIEVE_BITS, salts: int = SALTS, digest: str | None = None) -> DataFrame:
    """Groups of equal normalised texts, and the row of each that stays.

    docs: doc_id, text and any other columns, which are ignored. Returns one row for each row of docs: doc_id,
    keep_id (doc_id of the row that stays), group_size and kept, and under the name `digest`, if one is given, the
    SHA-256 of every normalised text (which then is computed for all rows, so the last round saves no hashing).

    Three rounds, each over the survivors of the one before. Rows whose length no other row has are alone; of the
    rest, so are rows whose (length, hash of the first `prefix` code points) no other row has; a full hash (SHA-256)
    is computed only for what is left. No text is ever shuffled: the rows that need the full hash are found again in
    a second scan through a filter of the surviving (length, prefix hash) pairs, sized by their number and broadcast
    (`most_bits` bounds it). A lone row that the filter lets through costs one hash, and changes no result.

    A group that holds a third of all rows is dealt over `salts` keys: counted there, summed, and told its result
    there again, so no task sees it whole.

    Null text equals empty text, and all such rows are one group. Of equal texts the row with the most code points in
    the original text stays; ties go to the smallest doc_id, null last. Rows are never joined by doc_id: null and
    repeated ids each return a row. Rows that repeat one doc_id are one document stored several times: each counts in
    group_size and each says kept if that document stays. Empty table: no rows.
    """
    rows = ids_only(docs, ("doc_id", "text"))
    norm = normalised(F.col("text"))
    shape = rows.select(
        F.octet_length(norm).alias("n"),
        F.xxhash64(F.substring(norm, 1, prefix)).alias("p"),
    )
    by_prefix = materialize(shape.groupBy("n", "p").agg(F.count("*").alias("c")))  # both rounds read it
    by_length = by_prefix.groupBy("n").agg(F.sum("c").alias("in_length"))
    # round 1 leaves lengths that two rows share, round 2 of these the prefixes that two rows share
    shared = materialize(by_prefix.join(by_length.filter("in_length > 1"), "n", "left_semi").filter("c > 1").select("n", "p"))
    pair = F.xxhash64("n", "p")
    sieve = Sieve(shared.select(pair.alias("h")), most_bits)
    # round 3: the full hash, read again from the input only where the filter says so
    seen = rows.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("chars"),
        F.octet_length(norm).alias("n"),
        F.xxhash64(F.substring(norm, 1, prefix)).alias("p"),
        norm.alias("norm"),
    )
    marked = sieve.marked(seen, pair, "look")
    full = F.sha2("norm", 256) if digest else F.when(F.col("look"), F.sha2("norm", 256))
    # the salt goes by a row's place, written down here, so that repeats of one row are dealt too
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    members = materialize(marked.select("doc_id", "chars", full.alias("digest"), "look", salt.alias("salt")))
    also = [F.col("digest").alias(digest)] if digest else []
    alone = members.filter("NOT look").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *also)
    grouped = members.filter("look")
    best = F.struct((-F.col("chars")).alias("less"), ordered_id(F.col("doc_id")).alias("of"))
    parts = grouped.groupBy("digest", "salt").agg(F.min(best).alias("best"), F.count("*").alias("c"))
    groups = parts.groupBy("digest").agg(F.min("best").alias("best"), F.sum("c").alias("group_size"))
    told = parts.select("digest", "salt").join(groups, "digest")
    out = grouped.join(told, ["digest", "salt"])
    return alone.unionByName(out.select("doc_id", F.col("best.of.id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.of.id")).alias("kept"), *also))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: the group it is in, and the SHA-256 of its normalised text."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), digest="text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS kept,
  sha256(norm) AS text_sha256
FROM d
"""
