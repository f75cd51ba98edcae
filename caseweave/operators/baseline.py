"""What is normal in a corpus of mail: domains, senders, recipients, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave import config as C
from caseweave.functions.text import alike_keys, looks_alike, term_present


def domain_baseline(messages: DataFrame, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """For each sender domain: messages, first and last day, authentication seen and passed, and what follows."""
    g = messages.filter("sender_domain <> ''").groupBy("sender_domain").agg(
        F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_if(F.col("auth").isin("pass", "fail")).alias("auth_seen"), F.count_if(F.col("auth") == "pass").alias("auth_pass"),
    )
    return g.withColumns({
        "enforces": (F.col("auth_seen") >= t.enforce_min) & (F.coalesce(F.try_divide("auth_pass", "auth_seen"), F.lit(0.0)) >= t.enforce_share),
        "frequent": F.col("n") >= t.domain_min, "established": F.col("n") >= t.established_min, "first_contact": F.col("n") <= 1,
    })


def frequent_senders(messages: DataFrame, least: int = 3) -> DataFrame:
    return messages.filter("sender <> ''").groupBy("sender").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def internal_domains(messages: DataFrame, recipient_domain: str, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Domains that send or receive often enough to be the organisation's own."""
    def often(col: str, least: int) -> DataFrame:
        return messages.filter(F.col(col) != "").groupBy(F.col(col).alias("domain")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("domain")

    return often("sender_domain", t.internal_sender_min).union(often(recipient_domain, t.internal_recipient_min)).distinct()


def sender_recipient_pairs(messages: DataFrame) -> DataFrame:
    return messages.filter("sender <> '' AND recipient <> ''").groupBy(F.lower("sender").alias("sender"), F.lower("recipient").alias("recipient")).agg(F.count("*").alias("n"))


def scenario(messages: DataFrame, forced: str = "", compromise: bool = False, anchored: bool = False, share: float = C.DEFAULTS.dominant_share) -> DataFrame:
    """One row: account takeover or impersonation, why, and the recipient that dominates the corpus."""
    counts = messages.filter("recipient <> ''").groupBy(F.lower("recipient").alias("recipient")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max_by("recipient", F.struct("n", "recipient")).alias("recipient"), F.max("n").alias("n"))
    total = messages.agg(F.count("*").alias("total"))
    part = F.coalesce(F.try_divide("n", "total"), F.lit(0.0))
    why = F.when(F.lit(forced != ""), "forced").when(F.lit(compromise), "compromise date").when(part >= share, "dominant mailbox").when(F.lit(anchored), "anchor").otherwise("default")
    kind = F.when(F.lit(forced != ""), forced).when(why.isin("compromise date", "dominant mailbox"), "ato").otherwise("impersonation")
    return top.crossJoin(total).select("recipient", "n", part.alias("share"), kind.alias("scenario"), why.alias("reason"))


def sending_ip_anomaly(events: DataFrame, frequent: int = 3) -> DataFrame:
    """sender, ip, seen: an address seen once for a sender who is frequent and uses others."""
    pairs = events.filter("ip <> ''").groupBy("actor", "ip").agg(F.count("*").alias("seen"))
    w = Window.partitionBy("actor")
    return pairs.withColumns({"n": F.sum("seen").over(w), "ips": F.count("*").over(w)}).filter((F.col("n") >= frequent) & (F.col("seen") <= 1) & (F.col("ips") > 1)).select("actor", "ip", "seen")


def familiarity(n: Column, established: int = C.DEFAULTS.established_min) -> Column:
    """established, known, new, or unknown for a domain the baseline lacks."""
    return F.when(n.isNull(), "unknown").when(n >= established, "established").when(n > 1, "known").otherwise("new")


def rule_keyword_policy(messages: DataFrame, keywords: tuple[str, ...], cap: float = C.DEFAULTS.rule_keyword_cap, text: str = "body") -> DataFrame:
    """keyword, hits, share, over_cap: how much of the corpus each keyword of a mailbox rule selects. One pass."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    one = messages.agg(F.count("*").alias("n"), *[F.count_if(low.contains(k)).alias(f"k{i}") for i, k in enumerate(keywords)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("hits")) for i, k in enumerate(keywords)]))
    share = F.coalesce(F.try_divide("x.hits", "n"), F.lit(0.0))
    return one.select("n", rows.alias("x")).select("x.keyword", "x.hits", share.alias("share"), (share > cap).alias("over_cap"))


def registration_age(domains: DataFrame, registered: DataFrame, reference_day: str = "day") -> DataFrame:
    """domain, age_days (whole days, 0 at least; null if unknown): domains (domain, day) against a table of registrations (domain, registered_day)."""
    r = registered.select(F.col("domain").alias("d"), "registered_day")
    return domains.join(r, domains["domain"] == r["d"], "left").select("domain", F.when(F.col("registered_day").isNotNull(), F.greatest(F.lit(0), F.col(reference_day) - F.col("registered_day"))).alias("age_days"))


def lookalikes(names: DataFrame, known: DataFrame, shortest: int = 5) -> DataFrame:
    """name, like_name: each of the names beside each known name (column name) that it looks like.

    An equi-join over alike_keys(), not all pairs: a name has as many keys as characters and two more, whatever the
    number of names. What shares a key is then compared."""
    a = names.select("name").distinct().filter(F.length("name") >= shortest).select("name", F.explode(alike_keys(F.col("name"))).alias("key"))
    b = known.select(F.col("name").alias("like_name")).distinct().select("like_name", F.explode(alike_keys(F.col("like_name"))).alias("key"))
    return a.join(b, "key").filter(looks_alike(F.col("name"), F.col("like_name"), shortest)).select("name", "like_name").distinct()


def term_frequencies(messages: DataFrame, text: Column, terms: tuple[str, ...]) -> DataFrame:
    """term, hits, n: in how many messages each term stands, of how many. One pass, one row from each task."""
    one = messages.agg(F.count("*").alias("n"), *[F.count_if(term_present(text, t)).alias(f"t{i}") for i, t in enumerate(terms)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("hits")) for i, t in enumerate(terms)]))
    return one.select("n", rows.alias("x")).select("x.term", "x.hits", "n")


def known_contacts(messages: DataFrame) -> DataFrame:
    """sender: each address that ever wrote."""
    return messages.filter("sender <> ''").select("sender").distinct()


def corpus_span(messages: DataFrame, sec: str = "sec") -> DataFrame:
    """One row: messages with a time, first and last, and the whole days between them (null for fewer than two)."""
    r = messages.agg(F.count(sec).alias("timed"), F.min(sec).alias("first_sec"), F.max(sec).alias("last_sec"))
    return r.withColumn("days", F.when(F.col("timed") >= 2, F.expr("(last_sec - first_sec) div 86400")))


def rule_keyword_fields(rules: DataFrame) -> DataFrame:
    """keyword, fields: which fields each keyword of a mailbox rule was looked for in. rules: conditions (a map of field
    to words) and keywords (words of a rule that says no field: subject and body, unless another rule says which)."""
    said = rules.filter("size(conditions) > 0").select(F.explode("conditions").alias("field", "words")).select(F.lower("field").alias("field"), F.explode("words").alias("w"))
    said = said.select(F.lower(F.trim("w")).alias("keyword"), "field").filter("keyword <> ''").groupBy("keyword").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    plain = rules.filter("coalesce(size(conditions), 0) <= 0").select(F.explode("keywords").alias("w")).select(F.lower(F.trim("w")).alias("keyword")).filter("keyword <> ''").distinct()
    both = F.array(F.lit("body"), F.lit("subject"))
    return said.join(plain.withColumn("open", F.lit(True)), "keyword", "full").select("keyword", F.coalesce("fields", both).alias("fields"))
