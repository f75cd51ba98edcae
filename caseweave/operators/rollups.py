"""Rollups: indicators, domains, histograms, graphs, pivots, the timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ioc_rollup(indicators: DataFrame, min_tier: int = 2, examples: int = 3) -> DataFrame:
    """For each indicator (type, value without case, URLs as they are): occurrences, span, best tier, best score, first
    context and the first example paths. indicators: type, value, context, path, day, tier, score."""
    i = indicators.filter((F.col("tier") <= min_tier) & (F.col("value") != "")).withColumn("value", F.when(F.col("type") == "url", F.col("value")).otherwise(F.lower("value")))
    g = i.groupBy("type", "value").agg(F.count("*").alias("occurrences"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("tier").alias("best_tier"), F.max("score").alias("max_score"), F.min_by("context", F.when(F.col("context") != "", F.col("path"))).alias("context"))
    one = i.select("type", "value", "path").distinct().withColumn("r", F.row_number().over(Window.partitionBy("type", "value").orderBy("path"))).filter(F.col("r") <= examples)
    ex = one.groupBy("type", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: p.cast("string")), "|").alias("examples"))
    return g.join(ex, ["type", "value"]).withColumn("context", F.coalesce("context", F.lit("")))


def top_domains(messages: DataFrame, k: int = 15) -> DataFrame:
    """The k domains with the highest tier, then score, among Tier 1 and 2."""
    g = messages.filter("tier IN (1, 2)").groupBy(F.when(F.col("sender_domain") == "", "(none)").otherwise(F.col("sender_domain")).alias("domain")).agg(
        F.count("*").alias("messages"), F.min("tier").alias("highest_tier"), F.sum("score").alias("total_score"), F.count_distinct("sender").alias("senders"))
    return g.orderBy("highest_tier", F.desc("total_score"), "domain").limit(k)


def histogram(values: DataFrame, col: str, edges: tuple[int, ...] = (0, 1, 5, 10, 15, 20, 30, 40, 60, 100)) -> DataFrame:
    """bucket, n by fixed edges; what no bucket holds counts in the last."""
    label = None
    for lo, hi in zip(edges, edges[1:]):
        inside = (F.col(col) >= lo) & (F.col(col) < hi)
        label = F.when(inside, f"{lo}-{hi - 1}") if label is None else label.when(inside, f"{lo}-{hi - 1}")
    return values.groupBy(label.otherwise(f">={edges[-1]}").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(values: DataFrame, col: str, qs: tuple[float, ...] = (0.5, 0.9, 0.99), bins: int = 4096) -> DataFrame:
    """min, max, mean and exact quantiles by floor rank: the value at place floor(q * (n - 1)).

    No task sorts all values: they are counted by value; approximate quantiles of the distinct values, which outliers
    don't move, cut them into up to `bins` ranges of about as many; only the ranges' counts meet, and only those that
    hold a wanted rank are put in order."""
    v = values.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    whole = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.percentile_approx("v", [i / bins for i in range(1, bins)], 4 * bins).alias("cuts"))
    whole = whole.withColumn("cuts", F.array_sort(F.array_distinct("cuts")))
    # the cuts are a few thousand: a binary search would need a function of its own, so a range starts at each cut
    starts = whole.select(F.explode(F.concat(F.array("lo"), F.col("cuts"))).alias("start")).distinct()
    ends = starts.select("start", F.lead("start").over(Window.orderBy("start")).alias("end"))  # `bins` rows at most
    ranged = v.join(F.broadcast(ends), (F.col("v") >= F.col("start")) & (F.col("end").isNull() | (F.col("v") < F.col("end"))))
    sums = ranged.groupBy("start").agg(F.sum("c").alias("in_range"))
    before = sums.select("start", "in_range", F.coalesce(F.sum("in_range").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = whole.select("lo", "hi", "n", "mean")
    ranks = F.array(*[F.floor(F.lit(q) * (F.col("n") - 1)) for q in qs])
    wanted = before.crossJoin(F.broadcast(total)).filter(F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("in_range"))))
    run = F.sum("c").over(Window.partitionBy("start").orderBy("v"))
    ranked = ranged.select("v", "c", "start").join(F.broadcast(wanted.select("start", "before")), "start").withColumn("upto", F.col("before") + run)
    picks = [F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("v"))).alias(f"p{int(q * 100)}") for q in qs]
    got = ranked.crossJoin(F.broadcast(total)).agg(F.first("lo").alias("min"), *picks, F.first("hi").alias("max"), F.round(F.first("mean"), 2).alias("mean"))
    return got


def entity_graph(edges: DataFrame, k: int = 150) -> DataFrame:
    """Nodes (the k of most weight) and links between them as rows: kind, a, b, n. edges: sender, other, type."""
    e = edges.filter("sender <> '' AND other <> '' AND sender <> other")
    nodes = e.select(F.explode(F.array("sender", "other")).alias("a")).groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(k)
    links = e.select(F.least("sender", "other").alias("a"), F.greatest("sender", "other").alias("b"), "type").groupBy("a", "b", "type").agg(F.count("*").alias("n"))
    keep = F.broadcast(nodes.select(F.col("a").alias("x")))
    links = links.join(keep, F.col("a") == F.col("x"), "left_semi").join(keep, F.col("b") == F.col("x"), "left_semi")
    return nodes.select(F.lit("node").alias("kind"), "a", F.lit("").alias("b"), "n").unionByName(links.select(F.col("type").alias("kind"), "a", "b", "n"))


def evidence_chain(shared: DataFrame, span: int = 4096) -> DataFrame:
    """source, target: each message and the next that shares an indicator. shared: relation, indicator, path.

    An indicator of over `span` messages is cut into ranges of paths, at approximate quantiles of its own; each range
    is chained by itself, and its last message to the first of the next range."""
    key = ["relation", "indicator"]
    x = shared.select(*key, "path").distinct()
    size = x.groupBy(*key).agg(F.count("*").alias("n"))
    hot = size.filter(F.col("n") > span).select(*[F.col(k).alias(f"__{k}") for k in key], F.ceil(F.col("n") / span).cast("int").alias("parts"))
    # paths of any type have an order but no quantiles: a sample's order statistics, one for each range, cut them
    own = [F.col(k) == F.col(f"__{k}") for k in key]
    some = x.join(hot, own).withColumn("h", F.xxhash64("path")).filter(F.pmod("h", F.lit(span // 16)) == 0)
    nth = F.row_number().over(Window.partitionBy("__relation", "__indicator").orderBy("path"))
    cuts = some.withColumn("nth", nth).filter(F.col("nth") % 16 == 0).groupBy("__relation", "__indicator").agg(F.array_sort(F.collect_list("path")).alias("cuts"))
    ranged = x.join(cuts, own, "left").withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("path"))), F.lit(0))).select(*key, "path", "range")
    nxt = F.lead("path").over(Window.partitionBy(*key, "range").orderBy("path"))
    firsts = ranged.groupBy(*key, "range").agg(F.min("path").alias("head"))
    heads = firsts.withColumn("follow", F.lead("head").over(Window.partitionBy(*key).orderBy("range"))).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("range").alias("_range"), "follow")
    one = ranged.withColumn("target", nxt)
    last = one.filter("target IS NULL").join(heads, [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("range") == F.col("_range")]).withColumn("target", F.col("follow"))
    out = one.filter("target IS NOT NULL").select(*key, "path", "target").unionByName(last.select(*key, "path", "target").filter("target IS NOT NULL"))
    return out.select(*key, F.col("path").alias("source"), "target")


def _bits(path, digits: int) -> Column:
    """The leading hex digits of a value's MD5, as a number."""
    return F.conv(F.substring(F.md5(path.cast("string")), 1, digits), 16, 10).cast("long")


def pivot_index(rows: DataFrame, key: str, path: str = "path") -> DataFrame:
    """key, n and a digest of the distinct paths that hold it, in any order: partial aggregates, so a hot key is no task's own."""
    pairs = rows.filter(F.col(key) != "").groupBy(F.col(key).alias("key"), F.col(path).alias("p")).agg(F.lit(1).alias("one"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(_bits(F.col("p"), 15)).alias("digest"))


def corpus_fingerprint(rows: DataFrame, path: str, content: str) -> DataFrame:
    """One digest of a corpus: SHA-256 over the sorted digests of up to 2^20 parts, each over its sorted lines. The parts are
    dealt by the path's hash, so no task holds the corpus."""
    line = F.concat_ws(":", F.col(path).cast("string"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    each = rows.groupBy(_bits(F.col(path), 5).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"), F.count("*").alias("n"))
    item = F.array_sort(F.collect_list(F.struct("part", "d")))
    return each.agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.transform(item, lambda x: x["d"]), "\n"), 256).alias("fingerprint"))


def timeline(frames: list[DataFrame]) -> DataFrame:
    """Events of several sources (sec, source, what, ref) in one table, ordered by time with unknown times last."""
    return union_all(frames).orderBy(F.asc_nulls_last("sec"), "source", "what", "ref")
