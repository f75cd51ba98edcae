"""Bodies: own and quoted text, signatures, blocks, and what repeats over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import config as C
from caseweave.functions.text import block_hash

# Lines at which a reply's history begins.
QUOTE = (
    r"(?im)(^\s*-{2,}\s*original message\s*-{2,}\s*$|^\s*-{2,}\s*forwarded message\s*-{2,}|^\s*_{10,}\s*$|^\s*from:[^\n]{0,200}\n\s*(?:sent|date):"
    r"|^\s*on\s[^\n]{0,300}\swrote:\s*$|^\s*el\s[^\n]{0,300}\sescribió:\s*$|^\s*le\s[^\n]{0,300}\sa écrit\s*:\s*$|^\s*am\s[^\n]{0,300}\sschrieb\s[^\n]{0,120}:\s*$)"
)
SIGNATURE = r"(?sm)^(.*)^[ \t]*(?:--[ \t]?|__+|—-)[ \t]*$(.*)$"
# Phrases of disclaimers, for corpora too small to show what repeats.
DISCLAIMER = r"(?i)(this e?-?mail[^.]{0,80}(and any attachments?|is confidential)|intended (solely|only) for|received this (e-?mail |message )?in error|unsubscribe|privileged and confidential|please consider the environment)"


def strip(text: Column) -> Column:
    """Without blanks and line ends at the edges."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def quote_start(body: Column) -> Column:
    """Where history begins, from 1; 0 for nowhere."""
    return F.coalesce(F.regexp_instr(body, F.lit(QUOTE)), F.lit(0))


def split_quoted(body: Column) -> Column:
    """A struct own, quoted: text before the first marker without lines that begin with >, and the rest."""
    b = F.coalesce(body, F.lit(""))
    at = quote_start(b)
    own = F.when(at > 0, F.substring(b, F.lit(1), at - 1)).otherwise(b)
    history = F.when(at > 0, F.substring(b, at, F.length(b))).otherwise("")
    lines = F.split(own, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\s*>")), "\n")
    moved = F.filter(lines, lambda x: x.rlike(r"^\s*>"))
    quoted = F.concat_ws("\n", F.nullif(F.array_join(moved, "\n"), F.lit("")), F.nullif(history, F.lit("")))
    return F.struct(strip(kept).alias("own"), strip(quoted).alias("quoted"))


def strip_signature(text: Column, most_lines: int = 20) -> Column:
    """Text before the last delimiter line, if no more than `most_lines` follow it."""
    tail = F.regexp_extract(text, SIGNATURE, 2)
    found = text.rlike(SIGNATURE)
    short = F.length(tail) - F.length(F.replace(tail, F.lit("\n"), F.lit(""))) <= most_lines
    return F.when(found & short, F.rtrim(F.regexp_extract(text, SIGNATURE, 1))).otherwise(text)


def blocks(text: Column, least: int = 60, separator: str = r"\n\s*\n") -> Column:
    """Blocks of at least `least` characters, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator, -1), strip), lambda b: F.length(b) >= least)


def exploded_blocks(messages: DataFrame, text: str = "body", least: int = 60, separator: str = r"\n\s*\n") -> DataFrame:
    """path, sender, day, pos, trailing, block, hash of each block."""
    m = messages.withColumn("blocks", blocks(F.col(text), least, separator))
    x = m.select("path", "sender", "day", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    return x.select("path", "sender", "day", "pos", (F.col("pos") == F.col("n") - 1).alias("trailing"), "block", block_hash(F.col("block")).alias("hash"))


def block_statistics(exploded: DataFrame, compromise_day: int | None = None) -> DataFrame:
    """For each block hash: copies, senders, span and how often it ends a message."""
    before = F.lit(False) if compromise_day is None else F.coalesce(F.col("day") < compromise_day, F.lit(False))
    return exploded.groupBy("hash").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("sender") != "", F.col("sender"))).alias("senders"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_if("trailing").alias("trailing"), F.bool_or(before).alias("pre_compromise"), F.min(F.when(F.col("sender") != "", F.col("sender"))).alias("sender"),
    )


def classify_blocks(stats: DataFrame, compromise_known: bool = False, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """kind: boilerplate (ends messages of several senders over a long time), burst (one sender, a short time), or null."""
    span = F.coalesce(F.col("last_day") - F.col("first_day"), F.lit(0))
    known = F.col("pre_compromise") if compromise_known else F.lit(True)
    boiler = (F.col("n") >= t.boiler_count) & (F.col("trailing") >= F.col("n") * 0.6) & (F.col("senders") >= t.boiler_senders) & (span >= t.boiler_days) & known
    burst = (F.col("n") >= t.burst_count) & (F.col("senders") == 1) & (span * 24 <= t.burst_hours)
    return stats.withColumn("kind", F.when(boiler, "boilerplate").when(burst, "burst"))


def strip_boilerplate(exploded: DataFrame, classified: DataFrame) -> DataFrame:
    """path, text without boilerplate blocks, and how many were removed. Where no block of the corpus is boilerplate,
    disclaimers among the last two blocks go instead."""
    known = classified.filter("kind = 'boilerplate'").select("hash", F.lit(True).alias("boiler"))
    usable = F.broadcast(known.agg((F.count("*") > 0).alias("usable")))
    last = F.max("pos").over(_by_path())
    x = exploded.join(known, "hash", "left").crossJoin(usable).withColumn("last", last)
    drop = F.when(F.col("usable"), F.coalesce("boiler", F.lit(False))).otherwise((F.col("pos") >= F.col("last") - 1) & F.col("block").rlike(DISCLAIMER))
    item = F.struct("pos", "block")
    return x.withColumn("drop", drop).groupBy("path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("drop"), item))), lambda b: b["block"]), "\n\n").alias("text"), F.count_if("drop").alias("removed"),
    )


def _by_path():
    from pyspark.sql.window import Window

    return Window.partitionBy("path")


def prepare_bodies(messages: DataFrame, compromise_day: int | None = None, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Messages (path, sender, day, body, ...) with body the sender's own text (no history, no signature, no block that the
    corpus shows to be boilerplate; the body as it was if nothing is left), quoted, and burst: whether a block of it
    belongs to a mass mailing.

    Two passes: blocks are counted over the corpus by partial aggregates, and only the few that are boilerplate or a
    burst come back to their messages."""
    s = split_quoted(F.col("body"))
    own = F.coalesce(F.nullif(strip_signature(s["own"]), F.lit("")), F.nullif(s["own"], F.lit("")), F.col("body"))
    m = messages.withColumns({"own": own, "quoted": s["quoted"]})
    x = exploded_blocks(m, "own")
    kinds = classify_blocks(block_statistics(x, compromise_day), compromise_day is not None, t).filter("kind IS NOT NULL").select("hash", "kind")
    hit = x.select("path", "block", "hash").join(kinds, "hash").groupBy("path").agg(F.collect_set(F.when(F.col("kind") == "boilerplate", F.col("block"))).alias("drop"), F.bool_or(F.col("kind") == "burst").alias("burst"))
    out = m.join(hit.withColumnRenamed("path", "of"), F.col("path") == F.col("of"), "left")
    less = F.aggregate(F.coalesce("drop", F.array().cast("array<string>")), F.col("own"), lambda text, b: F.replace(text, b, F.lit("")))
    return out.withColumns({"body": F.coalesce(F.nullif(strip(less), F.lit("")), "own"), "burst": F.coalesce("burst", F.lit(False))}).drop("own", "drop", "of")
