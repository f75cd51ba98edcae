"""From raw documents to shards: five stages, each an operator of caseweave.llm over all that the one before kept.

Stages return the columns of documents, whatever else these hold; the last adds shard_id, shard_depth, shard_bytes,
shard_docs, shard_oversize, mix_slot and mix_place (columns of documents with these names are replaced). run() writes each stage as Parquet
to the folder in spark.checkpoint.dir and reads it again, so no stage is computed twice and a lost executor costs one
stage's tasks at most. A stage's folder goes as soon as the next one is written; with a run_id, a run that lost its
driver goes on behind the last stage that was written whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.llm import decontaminate, language, mixing, sharding, simhash
from caseweave.llm._common import keep_ids, materialize, read_table, shared_folder

#: A document whose language is this unsure is rejected: far below any text of some words in one language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Rejected are null texts, texts without a letter, texts that no
    language fits better than others (score under LEAST_SCORE), and texts that even the best language doesn't fit: junk in
    letters, languages that the model doesn't know (the limit is calibrated on the held-out documents; a language
    without one has none). Empty model (no labelled document): all are rejected."""
    model = language.calibrate(language.fit(docs.filter(~language.held_out())), docs.filter(language.held_out()))
    return language.accepted(docs, model, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest doc_id. An id should name one text: rows that
    repeat id and text are one document, of which one row stays; null ids stay only in components without another."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = simhash.simhash_components(docs).groupBy("doc_id").agg(F.count_if(stays).alias("n"))
    ids = materialize(ids.filter("n <> 1"))  # most ids stay once: only the others are noted
    out, more = keep_ids(docs, ids.filter("n = 0").select("doc_id"), keep=False), ids.filter("n > 1").select("doc_id")
    if more.isEmpty():
        return out
    return keep_ids(out, more, keep=False).unionByName(keep_ids(out, more).dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return keep_ids(docs, materialize(found.filter(F.size("spans") > 0).select("doc_id").distinct()), keep=False)


def _text_hash() -> Column:
    """What tells documents of one id, or without one, apart in the mix."""
    return F.xxhash64("text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: part files, and rows in them, follow the slots, so any prefix of the
    written table has the sources at their target weights to within a block each, until a source runs out."""
    return mixing.mix_in_order(docs, tie=_text_hash())


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in the mix. Rows of a shard are written together, in the order of
    the mix: mix_slot and mix_place are derived again here (from ids, texts and sources, so as the mixing stage had
    them), as a shuffle by shard keeps no order of files. A shard is a sample by hash, so its prefixes have the mix too.

    Whole rows move once, to their shard. Narrow rows (shard, hash of id, source and text) are placed in the mix apart,
    move to the same shard, and give their places to the whole rows there, repeats in any order."""
    names = {"shard_id": "shard_id", "depth": "shard_depth", "shard_bytes": "shard_bytes", "shard_docs": "shard_docs", "oversize": "shard_oversize"}
    keep = tuple(c for c in docs.columns if c not in (*names.values(), "mix_slot", "mix_place"))
    found = sharding.shard_documents(docs, keep=keep).select("kept", *names)
    row = F.xxhash64("doc_id", F.isnull("doc_id"), "source", F.isnull("source"), _text_hash())
    narrow = found.select("kept.doc_id", "kept.source", "kept.text", "shard_id").select("doc_id", "source", "text", "shard_id", row.alias("row"))
    placed = mixing.mix_sources(narrow, keep=("shard_id", "row"), tie=_text_hash()).select("kept.shard_id", "kept.row", "slot", "place")
    whole = found.select(F.struct("kept", *names).alias("doc"), "shard_id", "kept.doc_id", "kept.source", "kept.text").select("doc", "shard_id", row.alias("row"))
    both = whole.unionByName(placed, allowMissingColumns=True).repartition("shard_id")
    is_doc = F.col("doc").isNotNull()
    nth = F.row_number().over(Window.partitionBy("shard_id", "row", "is_doc").orderBy("slot", "place"))
    both = both.withColumn("is_doc", is_doc).withColumn("nth", nth)
    pair = Window.partitionBy("shard_id", "row", "nth")
    both = both.withColumns({"mix_slot": F.max("slot").over(pair), "mix_place": F.max("place").over(pair)}).filter("is_doc")
    out = both.select("doc.kept.*", *[F.col(f"doc.{a}").alias(b) for a, b in names.items()], "mix_slot", "mix_place")
    return out.sortWithinPartitions("shard_id", "mix_slot", "mix_place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Language models and SimHash aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The last stage's rows over the whole table documents.

    run_id names the run's folder: a later run of the same id over the same tables reads the last stage that was
    written whole, and computes what comes after. Without one the name is new each time. The folder of the last stage
    but one stays, as the result is read from it."""
    folder = f"{shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    done = max((k for k, p in enumerate(paths) if run_id and _exists(spark, f"{p}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(paths[done]) if done >= 0 else read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k <= done:
            continue
        docs = stage(spark, docs, sf_dir)
        if k < len(paths):
            docs.write.mode("overwrite").parquet(paths[k])
            docs = spark.read.parquet(paths[k])
            if k:
                _delete(spark, paths[k - 1])
    return docs


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    files, path = _at(spark, path)
    return files.exists(path)


def _delete(spark: SparkSession, path: str) -> None:
    files, path = _at(spark, path)
    files.delete(path, True)
