"""Helpers that the operators share: salted groups, checked broadcasts, narrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.checkpoint import materialize, shared_folder  # noqa: F401  for the operators

#: A side is broadcast only while its counted rows times their width stay below this.
BROADCAST_BYTES = 32 << 20
#: Parts into which the rows of one group are dealt before they meet.
SALTS = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Lower the rows and the bytes of an Arrow batch, so that batches of long texts stay small. Lower settings stay.

    Spark reads both when it plans an operator, so they are the session's from here on; other operators give the
    same rows with them."""
    conf = spark.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key, "1g")) > size:
        conf.set(key, str(size))


def bounded_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def salted(*cols: Column, salts: int = SALTS) -> Column:
    """A salt from 0 to salts - 1 that depends on the row's own values, so that a rerun deals alike."""
    return F.pmod(F.xxhash64(*cols, F.lit("salt")), F.lit(salts)).cast("int")


def ordered_id(col: Column) -> Column:
    """A struct that sorts by id with null last."""
    return F.struct(col.isNull().alias("no_id"), col.alias("id"))


def ids_only(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Just the named columns: others, whatever they are called, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


#: Bits of a sieve for each hash put in, and at most: 16 MB are broadcast. A full sieve costs time, never rows.
SIEVE_EACH = 8
SIEVE_BITS = 1 << 27
#: Bits of one row of a sieve, as bitmap_construct_agg makes them.
BITMAP = 1 << 15


class Sieve:
    """A filter of the hashes (column h, long) of a table: every hash that was put in passes, others seldom.

    Its size follows their counted number, up to `most` bits. Built by partial aggregates; JVM only."""

    def __init__(self, hashes: DataFrame, most: int = SIEVE_BITS):
        self.bits = min(most, max(BITMAP, 1 << (SIEVE_EACH * hashes.count()).bit_length()))
        at = self._bucket(F.col("h")) + 1  # bitmaps count from one
        self.table = hashes.groupBy(F.bitmap_bucket_number(at).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bitmap"))

    def _bucket(self, h: Column) -> Column:
        return F.pmod(h, F.lit(max(BITMAP, self.bits)))

    def marked(self, df: DataFrame, h: Column, name: str) -> DataFrame:
        """df with a boolean column: whether h may be one of the hashes."""
        at = F.pmod(self._bucket(h), F.lit(BITMAP))
        byte = F.conv(F.hex(F.substring("__bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        there = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
        joined = df.withColumn("__own", F.bitmap_bucket_number(self._bucket(h) + 1)).join(F.broadcast(self.table), F.col("__own") == F.col("__part"), "left")
        return joined.withColumn(name, there).drop("__own", "__part", "__bitmap")


def keep_ids(docs: DataFrame, ids: DataFrame, keep: bool = True, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs whose doc_id is (or is not) among ids, with docs' own columns.

    ids is one column doc_id; null matches null. It is counted, and broadcast if small. Else rows first pass a sieve of
    the ids, and only those that it holds back are shuffled to be compared; the others, whole texts mostly, stay where
    they are."""
    side = ids.select(F.col("doc_id").alias("__id"))
    how = "left_semi" if keep else "left_anti"
    if side.count() * 128 <= limit:
        return docs.join(F.broadcast(side), docs["doc_id"].eqNullSafe(F.col("__id")), how)
    h = F.xxhash64(F.col("doc_id"))
    marked = Sieve(side.select(F.xxhash64("__id").alias("h"))).marked(docs, h, "__maybe")
    maybe = marked.filter("__maybe").drop("__maybe")
    exact = maybe.join(side, maybe["doc_id"].eqNullSafe(side["__id"]), how)
    return exact if keep else exact.unionByName(marked.filter("NOT __maybe").drop("__maybe"))


def tokenizer_path(name: str, folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)
