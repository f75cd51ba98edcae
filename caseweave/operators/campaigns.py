"""Campaigns: blocking, similarity of pairs, components and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave import config as C
from caseweave.checkpoint import materialize
from caseweave.functions.text import jaccard
from caseweave.operators.graph import components


def similarity(a: str, b: str, max_days: int = 30) -> Column:
    """Similarity of two feature structs: sender, domain, subject_tokens, terms, urls, files, hashes, recipients, day."""
    def shared(field: str) -> Column:
        return F.size(F.array_intersect(F.col(f"{a}.{field}"), F.col(f"{b}.{field}")))

    def same(field: str) -> Column:
        return (F.col(f"{a}.{field}") != "") & (F.col(f"{a}.{field}") == F.col(f"{b}.{field}"))

    subject = jaccard(F.col(f"{a}.subject_tokens"), F.col(f"{b}.subject_tokens"))
    days = F.abs(F.col(f"{a}.day") - F.col(f"{b}.day"))
    parts = [
        F.when(same("sender"), 0.30), F.when(same("domain"), 0.12), F.least(F.lit(0.30), shared("urls") * 0.15), F.when(shared("files") > 0, 0.20), F.when(shared("hashes") > 0, 0.35),
        F.when(subject >= 0.5, 0.25).when(subject >= 0.25, 0.12), F.least(F.lit(0.25), shared("terms") * 0.08), F.when(shared("recipients") > 0, 0.10),
    ]
    base = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    near = F.when(days <= 1, 0.12).when(days <= 3, 0.08).when(days <= 7, 0.05)
    total = base + F.coalesce(near, F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.when(days > max_days, total * 0.5).otherwise(total)), 6)


#: Members of a key that one task compares; a larger key is dealt over pairs of parts of this size.
PART = 4096
#: What a sender and a domain in common add up to: with no more than 30 days apart, the least similarity of such messages.
SAME_SENDER = 0.42
#: Keys of a message, of those with most members, that are tried as containing its others.
WIDEST = 8


def _keysets(features: DataFrame, keys: dict[str, tuple[Column, bool]], t: C.Thresholds) -> DataFrame:
    """path, keys: the numbers of the keys that each path shares with another, ascending; a key of more messages has a
    smaller number. A key whose members all share another, larger one (a sender's, those of its domain) is left out:
    its pairs meet there."""
    made = []
    for name, (col, weak) in keys.items():
        x = features.select("path", F.explode(F.array_distinct(col)).alias("key")).filter("key <> ''")
        made.append(x.select("path", F.concat(F.lit(f"{name}:"), "key").alias("key"), F.lit(weak).alias("weak")))
    rows = made[0]
    for x in made[1:]:
        rows = rows.union(x)
    good = rows.groupBy("key").agg(F.count("*").alias("n"), F.first("weak").alias("weak")).filter("n > 1")
    if t.strong_bucket:
        good = good.withColumn("n", F.least("n", F.lit(t.strong_bucket)))
    if t.weak_bucket:
        good = good.filter(~F.col("weak") | (F.col("n") <= t.weak_bucket))
    good = materialize(good.orderBy(F.desc("n"), "key").select(F.col("key").alias("k"), F.monotonically_increasing_id().alias("id")))
    if t.strong_bucket:
        rank = F.row_number().over(Window.partitionBy("key").orderBy("path"))
        rows = rows.withColumn("r", rank).filter(F.col("r") <= t.strong_bucket)
    sets = materialize(rows.join(good, F.col("key") == F.col("k")).groupBy("path").agg(F.sort_array(F.collect_set("id")).alias("keys")))
    wider = F.expr(f"explode(flatten(transform(slice(keys, 1, {WIDEST}), w -> transform(filter(keys, k -> k > w), k -> struct(k AS k, w AS w)))))")
    within = sets.select(wider.alias("x")).groupBy("x.k", "x.w").agg(F.count("*").alias("both"))
    single = sets.select(F.explode("keys").alias("k"))
    inside = within.join(single.groupBy("k").agg(F.count("*").alias("n")), "k").filter("both = n").select("k").distinct()
    kept = sets.select("path", F.explode("keys").alias("k")).join(inside, "k", "left_anti")
    return kept.groupBy("path").agg(F.sort_array(F.collect_list("k")).alias("keys"))


def _members(features: DataFrame, keys: dict[str, tuple[Column, bool]], t: C.Thresholds, columns: list[str]) -> DataFrame:
    """key (a number), keys (all of the path's), path and these columns for each message and key that another has."""
    sets = _keysets(features, keys, t).withColumnRenamed("path", "own_path")
    both = features.select("path", *columns).join(sets, F.col("path") == F.col("own_path"))
    return both.select(F.explode("keys").alias("key"), "keys", "path", *columns)


def _met(members: DataFrame, reach: Column | None, part: int) -> DataFrame:
    """Members x and y of the pairs that share a key and fulfil `reach`, each once: where the first key that they share
    is. Members of a key of over `part` messages are dealt by a hash of the path over parts; each pair of parts meets as
    a cell, in which x comes from the one and y from the other, so a key with a third of all messages is no task's own
    and no pair is looked at from both sides. No pair is shuffled. The condition has no function of higher order, which
    would keep the join from being compiled, and cells meet by one number, which is the fastest kind of hash table; what
    it stands for is compared too."""
    columns = [c for c in members.columns if c not in ("key", "keys", "path")]
    sizes = members.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("path", F.lit("part")), F.col("parts")).cast("int")
    dealt = members.join(sizes, F.col("key") == F.col("k")).select("key", "keys", "path", *columns, "parts", own.alias("own"), F.coalesce(F.col("keys")[0], "key").alias("least"))

    def role(others: Column, first: str, second: str, more: list) -> DataFrame:
        out = dealt.withColumn("other", F.explode(others))
        pair = F.shiftleft(F.col(first).cast("long"), 31).bitwiseOR(F.col(second).cast("long")).alias("parts")
        return out.select(F.xxhash64("key", first, second).alias("cell"), "key", F.coalesce(pair, F.lit(0).cast("long")).alias("parts"), "least", "path", F.coalesce(F.col("own") == F.col("other"), F.lit(False)).alias("alone"), *columns, *more)

    x = role(F.sequence(F.col("own"), F.col("parts") - 1), "own", "other", [F.filter("keys", lambda k: k < F.col("key")).alias("before")]).alias("x")
    y = role(F.sequence(F.lit(0), F.col("own")), "other", "own", ["keys"]).alias("y")
    once = ~F.col("x.alone") | (F.col("x.path") < F.col("y.path"))
    same = (F.col("x.key").bitwiseXOR(F.col("y.key")) == 0) & (F.col("x.parts").bitwiseXOR(F.col("y.parts")) == 0)
    first = (F.col("x.least") == F.col("x.key")) | (F.col("y.least") == F.col("x.key")) | (F.col("x.least") != F.col("y.least"))
    met = x.join(y.hint("shuffle_hash"), (F.col("x.cell") == F.col("y.cell")) & (reach if reach is not None else F.lit(True)) & once & first & same)
    # With the task's number in it, the look into lists of keys isn't moved into the join's condition, which fetches all it needs for each two rows.
    again = F.when(F.spark_partition_id() < 0, False).when((F.col("x.least") == F.col("x.key")) | (F.col("y.least") == F.col("x.key")), True).otherwise(~F.arrays_overlap("x.before", "y.keys"))
    return met.filter(again)


def candidate_pairs(features: DataFrame, keys: dict[str, tuple[Column, bool]], t: C.Thresholds = C.DEFAULTS, part: int = PART) -> DataFrame:
    """Pairs (a, b: structs, a.path < b.path) of messages that share a key.

    keys: name to (a column, or an array of keys; whether the key is weak). With t.weak_bucket and t.strong_bucket weak
    keys of more messages say nothing and are left out, and of strong ones only so many lowest paths are compared; with
    0 there is no cap, and all pairs of every key come back. Empty keys are left out."""
    whole = features.withColumn("f", F.struct(*features.columns))
    ordered = F.col("x.path") < F.col("y.path")
    return _met(_members(whole, keys, t, ["f"]), None, part).select(F.when(ordered, F.col("x.f")).otherwise(F.col("y.f")).alias("a"), F.when(ordered, F.col("y.f")).otherwise(F.col("x.f")).alias("b"))


#: Words of a subject are told apart in the sketch by this many bits, 64 in each of its numbers.
SKETCH = 256


def _sketched(features: DataFrame) -> DataFrame:
    """features with the words of subjects as sorted numbers (subject_tokens), how many (words), a sketch of them (s0, ...: which
    remainders their numbers leave), and has: which other lists have members, as bits."""
    rest = [c for c in features.columns if c != "subject_tokens"]
    base = materialize(features.withColumn("row", F.monotonically_increasing_id()))
    words = base.select("row", F.explode(F.array_distinct("subject_tokens")).alias("word"))
    numbers = materialize(words.groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n")).select("w", F.monotonically_increasing_id().alias("id")))
    place = F.pmod(F.xxhash64("id"), F.lit(SKETCH)).cast("int")
    bits = [F.bit_or(F.when(F.floor(place / 64) == j, F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"s{j}") for j in range(SKETCH // 64)]
    found = words.join(numbers, F.col("word") == F.col("w")).groupBy(F.col("row").alias("r")).agg(F.sort_array(F.collect_list("id")).alias("subject_tokens"), F.count("*").cast("int").alias("words"), *bits)
    has = sum((F.coalesce(F.size(c) > 0, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(LISTS)), F.lit(0))
    out = base.select("row", *rest, has.alias("has")).join(found, F.col("row") == F.col("r"), "left")
    none = [F.coalesce(F.col(f"s{j}"), F.lit(0).cast("long")).alias(f"s{j}") for j in range(SKETCH // 64)]
    lists = sum((F.when(F.col("has").bitwiseAND(F.lit(1 << i)) != 0, most).otherwise(0) for i, most in enumerate(LISTS.values())), F.lit(0))
    bits = sum((F.bit_count(F.coalesce(f"s{j}", F.lit(0).cast("long"))) for j in range(SKETCH // 64)), F.lit(0))
    # Of 5 times the words less those whose bit another has set: what more of common bits than words in common takes (_far).
    lack = F.when(F.coalesce("words", F.lit(0)) == 0, 1 << 20).otherwise(5 * bits - 4 * F.col("words"))
    derived = [F.coalesce(lists, F.lit(0)).alias("most"), F.coalesce(lack, F.lit(1 << 20)).alias("lack"), (F.col("day") + 30).alias("day30")]
    names = [F.coalesce(F.when(F.col(c) != "", F.xxhash64(c)), F.lit(0).cast("long")).alias(f"{c}_hash") for c in ("sender", "domain")]
    return out.select(*rest, "has", "subject_tokens", F.coalesce("words", F.lit(0)).alias("words"), *none, *names, *derived)


#: Lists of which two messages can share members, and the most that this adds to their similarity, in hundredths.
LISTS = {"urls": 30, "files": 20, "hashes": 35, "terms": 25, "recipients": 10}


#: What of a message pairs are compared by.
COMPARED = ["day", "day30", "most", "lack", "sender", "domain", "sender_hash", "domain_hash", *LISTS, "has", "subject_tokens", "words", *[f"s{j}" for j in range(SKETCH // 64)]]


def _far() -> Column:
    """Whether the sketches show that under a quarter of the words of two subjects is shared. A bit of one that the other lacks
    is a word that it lacks, so of its words at most (words - its bits + common bits) are shared; lack holds what of that
    is known of one message."""
    common = sum((F.bit_count(F.col(f"x.s{j}").bitwiseAND(F.col(f"y.s{j}"))) for j in range(1, SKETCH // 64)), F.bit_count(F.col("x.s0").bitwiseAND(F.col("y.s0")))) * 5
    return (common < F.col("x.lack") + F.col("y.words")) | (common < F.col("y.lack") + F.col("x.words"))


def _near() -> Column:
    """What days apart add to the similarity of x and y, in hundredths."""
    days = F.abs(F.col("x.day") - F.col("y.day"))
    return F.when(days <= 1, 12).when(days <= 3, 8).when(days <= 7, 5).otherwise(0)


def _reaches(least: float) -> Column:
    """Whether a pair can be of this similarity, by what is cheapest to tell, as it is asked of each two members of a key: days
    count as near, and lists that both have as equal."""
    total = F.when(F.col("x.domain_hash") == F.col("y.domain_hash"), 24).otherwise(12) + F.when(F.col("x.sender_hash") == F.col("y.sender_hash"), 30).otherwise(0)
    total = total + F.when(F.col("x.has").bitwiseAND(F.col("y.has")) == 0, 0).otherwise(F.col("x.most"))
    once, twice = (math.ceil(n * 100 * least - 1e-6) for n in (1, 2))
    apart = (F.col("x.day") > F.col("y.day30")) | (F.col("y.day") > F.col("x.day30"))
    need = F.when(apart, twice).otherwise(once)
    return (total + 25 >= need) & ((total >= need) | ~_far())


def _linked(members: DataFrame, threshold: float, out: list[str], on: Column | None = None, part: int = PART) -> DataFrame:
    """These columns of x and y (x_, y_) and the similarity of pairs that reach the threshold.

    Lists that nobody has are left out, as the JVM doesn't compile methods that are too long. All that similarity() adds are
    hundredths, so whole numbers stand for them, without a rounding of doubles for each pair."""
    used = members.agg(F.bit_or("has")).first()[0] or 0
    lists = [c for i, c in enumerate(LISTS) if used & (1 << i)]
    members = members.drop(*[c for c in LISTS if c not in lists])
    reach = _reaches(threshold)
    met = _met(members, reach if on is None else on & reach, part)

    def same(field: str, adds: int) -> Column:
        return F.when((F.col(f"x.{field}_hash") == F.col(f"y.{field}_hash")) & (F.col(f"x.{field}") != "") & (F.col(f"x.{field}") == F.col(f"y.{field}")), adds).otherwise(0)

    has, far = F.col("x.has").bitwiseAND(F.col("y.has")), _far()
    taken = [F.when(has.bitwiseAND(F.lit(1 << i)) != 0, F.col(f"{a}.{c}")).alias(f"{a}_{c}_in") for i, c in enumerate(LISTS) if c in lists for a in ("x", "y")]
    met = met.select(
        *[F.col(f"{a}.{c}").alias(f"{a}_{c}") for a in ("x", "y") for c in out], (same("sender", 30) + same("domain", 12) + _near()).alias("base"), F.when(F.abs(F.col("x.day") - F.col("y.day")) > 30, 5).otherwise(10).alias("times"),
        (F.col("x.words") + F.col("y.words")).alias("every"), *[F.when(~far, F.col(f"{a}.subject_tokens")).alias(f"{a}_words_in") for a in ("x", "y")], *taken,
    )

    def shared(name: str) -> Column:
        x, y = F.col(f"x_{name}_in"), F.col(f"y_{name}_in")
        return F.when(x.isNull() | y.isNull(), 0).otherwise(F.size(F.array_intersect(x, y)))

    words = F.when(F.col("x_words_in") == F.col("y_words_in"), F.size("x_words_in")).otherwise(shared("words"))
    met = met.select("*", F.coalesce(words, F.lit(0)).alias("both"), *[shared(c).alias(f"n_{c}") for c in lists])
    of = {"urls": lambda n: F.least(F.lit(30), n * 15), "files": lambda n: F.when(n > 0, 20).otherwise(0), "hashes": lambda n: F.when(n > 0, 35).otherwise(0), "terms": lambda n: F.least(F.lit(25), n * 8), "recipients": lambda n: F.when(n > 0, 10).otherwise(0)}
    both, every = F.col("both"), F.col("every")
    subject = F.when((both > 0) & (both * 3 >= every), 25).when((both > 0) & (both * 5 >= every), 12).otherwise(0)
    total = F.col("base") + subject + sum((of[c](F.col(f"n_{c}")) for c in lists), F.lit(0))
    # The task's number, times 0, keeps the filter from being moved before the lists' comparison.
    similarity = F.least(F.lit(1000), total * F.col("times") + F.spark_partition_id() * 0) / F.lit(1000.0)
    return met.select(*[f"{a}_{c}" for a in ("x", "y") for c in out], similarity.alias("similarity")).filter(F.col("similarity") >= threshold)


def campaign_links(features: DataFrame, keys: dict[str, tuple[Column, bool]], t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """a, b, similarity of pairs that reach the threshold. Their number grows with the square of a sender's messages; they
    are made where they meet and neither shuffled nor kept. For campaigns alone, campaign_members needs no such list."""
    found = _linked(materialize(_members(_sketched(features), keys, t, COMPARED)), t.campaign_threshold, ["path"])
    return found.select(F.least("x_path", "y_path").alias("a"), F.greatest("x_path", "y_path").alias("b"), "similarity")


def campaign_members(features: DataFrame, keys: dict[str, tuple[Column, bool]], t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """path, campaign (its lowest path) of all messages with a link: campaigns(campaign_links(...)) without that list.

    Messages of a sender and domain at most 30 days apart are linked for sure (unless the threshold is above that), so the
    days of each sender make chains. Then only pairs of different chains are compared, and of their links one for each
    pair of chains goes on."""
    members = materialize(_members(_sketched(features), keys, t, COMPARED))
    sure = members.select("key", "path", "sender", "domain", "day").filter("sender <> '' AND domain <> '' AND day IS NOT NULL")
    if t.campaign_threshold > SAME_SENDER:
        sure = sure.limit(0)
    group = ["key", "sender", "domain"]
    days = sure.groupBy(*group, "day").agg(F.min("path").alias("low"))
    w = Window.partitionBy(*group).orderBy("day")
    chained = days.select("low", F.lag("low").over(w).alias("before"), (F.col("day") - F.lag("day").over(w)).alias("gap")).filter("gap <= 30").select(F.col("low").alias("a"), F.col("before").alias("b"))
    chains = materialize(components(sure.join(days, [*group, "day"]).select(F.col("path").alias("a"), F.col("low").alias("b")).union(chained)).select(F.col("node").alias("in_chain"), F.col("component").alias("chain")))
    rest = materialize(members.join(chains, F.col("path") == F.col("in_chain"), "left").select(*members.columns, F.coalesce("chain", "path").alias("chain")))
    links = _linked(rest, t.campaign_threshold, ["chain"], F.col("x.chain") != F.col("y.chain"))
    links = links.select(F.least("x_chain", "y_chain").alias("a"), F.greatest("x_chain", "y_chain").alias("b")).distinct()
    joined = materialize(components(links))
    of_chains = chains.join(joined, F.col("chain") == F.col("node"), "left").select(F.col("in_chain").alias("path"), F.coalesce("component", "chain").alias("campaign"))
    single = joined.join(chains, F.col("node") == F.col("in_chain"), "left_anti").select(F.col("node").alias("path"), F.col("component").alias("campaign"))
    return of_chains.union(single)


def campaigns(links: DataFrame) -> DataFrame:
    """path, campaign (its lowest path)."""
    return components(links).select(F.col("node").alias("path"), F.col("component").alias("campaign"))


def campaign_summary(members: DataFrame) -> DataFrame:
    """For each campaign: size, span, senders, domains, score, origin and confidence. members: campaign, path, sender,
    domain, day, score, precursor, urls."""
    base = members.groupBy("campaign").agg(
        F.count("*").alias("size"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array_join(F.sort_array(F.collect_set("sender")), ",").alias("senders"),
        F.count_distinct("domain").alias("domains"), F.max("score").alias("top"), F.sum("score").alias("total"), F.bool_or("precursor").alias("precursor"),
        F.min_by("path", F.struct((-(F.col("score") + F.when(F.col("precursor"), 20).otherwise(0))).alias("s"), F.coalesce("day", F.lit(1 << 40)).alias("d"), "path")).alias("origin"),
    )
    urls = members.select("campaign", F.explode_outer("urls").alias("u")).groupBy("campaign").agg(F.count_distinct("u").alias("url_domains"))
    out = base.join(urls, "campaign")
    score = (
        F.col("top") + F.when(F.col("size") > 1, F.least(F.lit(10), F.expr("(total - top) div 3"))).otherwise(0) + F.when(F.col("size") >= 3, 3).otherwise(0) + F.when(F.col("domains") >= 2, 3).otherwise(0)
        + F.least(F.lit(6), F.col("url_domains") * 2) + F.when(F.col("precursor"), 5).otherwise(0)
    )
    out = out.withColumn("score", score.cast("long"))
    sure = F.when(F.col("score") >= 35, "high").when((F.col("score") >= 22) & (F.col("size") >= 2), "medium").when((F.col("size") >= 3) & F.col("precursor"), "medium").otherwise("low")
    return out.select("campaign", "size", "first_day", "last_day", "senders", "domains", "url_domains", "score", "origin", sure.alias("confidence"))


def campaign_indicators(members: DataFrame) -> DataFrame:
    """campaign, indicators: what speaks for each campaign, in a fixed order. members: campaign, path, sender, domain, score,
    precursor, urls (domains), files (names). What repeats is counted by value before the campaigns are put together."""
    def repeats(col: Column, name: str) -> DataFrame:
        n = members.select("campaign", col.alias("v")).filter("v <> ''").groupBy("campaign", "v").agg(F.count("*").alias("c"))
        return n.groupBy("campaign").agg((F.max("c") >= 2).alias(name))

    base = members.groupBy("campaign").agg(
        F.count("*").alias("size"), F.bool_or(F.exists("files", lambda f: f.rlike(r"[^/\\\\]\.[^./\\\\\s]+$"))).alias("by_file"), F.bool_or("precursor").alias("precursor"), F.max("score").alias("top"))
    out = base
    for name, col in (("senders", F.col("sender")), ("domains", F.col("domain")), ("urls", F.explode("urls"))):
        out = out.join(repeats(col, name), "campaign", "left")
    # The wording of the indicators.
    said = [
        (F.col("size") >= 3, F.concat(F.lit("Campaign contains "), F.col("size"), F.lit(" related messages"))), (F.col("senders"), F.lit("Repeated sender identity across campaign")), (F.col("domains"), F.lit("Repeated sender infrastructure/domain")),
        (F.col("urls"), F.lit("Multiple messages share URL infrastructure")), (F.col("by_file"), F.lit("Campaign contains attachment-based delivery")), (F.col("precursor"), F.lit("Campaign contains a message identified as a possible precursor")),
        (F.col("top") >= 15, F.lit("Campaign contains a high-confidence investigation candidate")),
    ]
    return out.select("campaign", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in said]), lambda x: x.isNotNull()).alias("indicators"))
