"""Mail, audit log and sign-ins brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave import config as C
from caseweave.operators.audit import one_of


def message_events(messages: DataFrame, events: DataFrame, attacker_ips: tuple[str, ...]) -> DataFrame:
    """For each message with events on its Message-ID: matched, by the attacker, confirmed (deliberate and by the attacker), read only.

    Events are summed up by id before the join, so a much used id meets each message as one row."""
    e = events.filter("message_id <> ''").groupBy(F.lower("message_id").alias("id")).agg(
        F.count("*").alias("matched"), F.count_if(one_of("ip", attacker_ips)).alias("by_attacker"),
        F.bool_or(one_of("ip", attacker_ips) & one_of("op_lower", C.DELIBERATE_OPS)).alias("confirmed"), F.count_distinct("op").alias("actions"),
    )
    m = messages.filter("message_id <> ''").select("path", F.lower("message_id").alias("id"))
    return m.join(e, "id").select("path", "matched", "by_attacker", "confirmed", "actions", ((F.col("by_attacker") > 0) & ~F.col("confirmed")).alias("read_only"))


def deleted_absent(events: DataFrame, messages: DataFrame) -> DataFrame:
    """message_id, n, present: ids that the log says were deleted, and whether the corpus still has them."""
    gone = events.filter(one_of("op_lower", C.DELETE_OPS) & (F.col("message_id") != "")).groupBy(F.lower("message_id").alias("message_id")).agg(F.count("*").alias("n"))
    have = messages.select(F.lower("message_id").alias("message_id")).distinct().withColumn("there", F.lit(True))
    return gone.join(have, "message_id", "left").select("message_id", "n", F.coalesce("there", F.lit(False)).alias("present"))


def attacker_authorship(messages: DataFrame, events: DataFrame, attacker_ips: tuple[str, ...], since_sec: int) -> DataFrame:
    """path, route: messages sent from the attacker's address, in the window after the compromise, or by staff."""
    sent = events.filter(one_of("op_lower", C.SEND_OPS)).groupBy(F.lower("message_id").alias("id")).agg(F.bool_or(one_of("ip", attacker_ips)).alias("atk"), F.max("sec").alias("last"))
    route = F.when(F.col("atk"), "attacker").when(F.col("last") >= since_sec, "window").otherwise("staff")
    return messages.select("path", F.lower("message_id").alias("id")).join(sent, "id").select("path", route.alias("route"))


def exposure_scope(messages: DataFrame, reads: DataFrame, attacker_ips: tuple[str, ...]) -> DataFrame:
    """For each message the attacker read: reads, first time, how it was read first, whether it is a lower bound.
    reads: message_id, ip, sec, event_id, access_type, throttled."""
    mine = reads.filter(one_of("ip", attacker_ips)).groupBy(F.lower("message_id").alias("id")).agg(
        F.count("*").alias("reads"), F.min("sec").alias("first_sec"), F.min_by("access_type", F.struct("sec", "event_id")).alias("first_access"), F.bool_or("throttled").alias("lower_bound"),
    )
    m = messages.groupBy(F.lower("message_id").alias("id")).agg(F.count("*").alias("copies"))
    return mine.join(m, "id", "left").select(F.col("id").alias("message_id"), "reads", "first_sec", "first_access", "lower_bound", F.coalesce("copies", F.lit(0)).alias("copies"))


def lure_window(lures: DataFrame, tokens: DataFrame, window_sec: int = 1200) -> DataFrame:
    """lure, token, gap: messages (id, user, sec) that arrived within a window before a token (id, user, sec) of their user.

    An interval join by time buckets of the window's length: each lure goes to its own bucket and the next one, so it
    meets only tokens near it, however many there are."""
    b = F.floor(F.col("sec") / window_sec)
    left = lures.select(F.col("id").alias("lure"), "user", F.col("sec").alias("at"), F.explode(F.array(b, b + 1)).alias("bucket"))
    right = tokens.select(F.col("id").alias("token"), F.col("user").alias("u"), "sec", b.alias("b"))
    hit = left.join(right, (F.col("user") == F.col("u")) & (F.col("bucket") == F.col("b")) & F.col("at").between(F.col("sec") - window_sec, F.col("sec")))
    return hit.select("lure", "token", (F.col("sec") - F.col("at")).alias("gap"))


def tokens_without_lure(lures: DataFrame, tokens: DataFrame, window_sec: int = 1200) -> DataFrame:
    """Tokens (id) that no message went before within the window."""
    hit = lure_window(lures, tokens, window_sec).select(F.col("token").alias("id")).distinct()
    return tokens.select("id").join(hit, "id", "left_anti")


def first_lure(lures: DataFrame, tokens: DataFrame, window_sec: int = 1200) -> DataFrame:
    """The first token after each message, within the window."""
    rank = F.row_number().over(Window.partitionBy("lure").orderBy("gap", "token"))
    return lure_window(lures, tokens, window_sec).withColumn("r", rank).filter("r = 1").drop("r")


def rule_replay(messages: DataFrame, rules: list[dict], day: str = "day") -> DataFrame:
    """rule, before, after: how many messages each rule's conditions match before and from its creation day. One pass
    over the corpus; rules (name, created_day, subject, body, sender: words) are a few and become expressions."""
    def matches(r: dict) -> Column:
        out = F.lit(False)
        for field in ("subject", "body", "sender"):
            low = F.lower(F.coalesce(F.col(field), F.lit("")))
            for w in r.get(field, ()):
                out |= low.contains(w.lower())
        return out

    if not rules:
        return messages.select(F.lit("").alias("rule"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("after")).limit(0)
    aggs = []
    for i, r in enumerate(rules):
        aggs += [F.count_if(matches(r) & (F.col(day) < r["created_day"])).alias(f"b{i}"), F.count_if(matches(r) & (F.col(day) >= r["created_day"])).alias(f"a{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("rule"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after")) for i, r in enumerate(rules)]))
    return messages.agg(*aggs).select(rows.alias("x")).select("x.*")


def attachment_substitution(attachments: DataFrame, compromise_day: int) -> DataFrame:
    """thread, name, first and later copy of other bytes, score: later copies compared with the first by a window, not
    a self-join. attachments: path, thread, name, sha, day, sender, domain. Of copies of one day and path the one with
    the smallest sha is first (then sender and domain; nulls last), so the result doesn't depend on any order of rows."""
    w = Window.partitionBy("thread", "name").orderBy("day", "path", *[F.asc_nulls_last(c) for c in ("sha", "sender", "domain")])
    first = F.first(F.struct("path", "sha", "day", "sender", "domain")).over(w)
    x = attachments.withColumn("f", first).filter(F.col("sha") != F.col("f.sha"))
    late = F.when(F.col("day") < compromise_day, 0).when(F.col("f.day") < compromise_day, 3).otherwise(2)
    other = F.when((F.col("domain") != "") & (F.col("f.domain") != "") & (F.col("domain") != F.col("f.domain")), 3).when((F.col("sender") != "") & (F.col("f.sender") != "") & (F.col("sender") != F.col("f.sender")), 1).otherwise(0)
    score = F.coalesce(late, F.lit(0)) + F.coalesce(other, F.lit(0))
    return x.select("thread", "name", F.col("f.path").alias("original"), "path", F.col("f.sha").alias("original_sha"), "sha", score.alias("score"), (score >= 5).alias("indicated"))


def unexplained(config_rows: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Rows of a configuration export that no audit record explains."""
    return config_rows.join(recorded.select(key).distinct(), key, "left_anti")


def trace_gap(trace: DataFrame, messages: DataFrame, senders: tuple[str, ...], since_sec: int) -> DataFrame:
    """Outbound rows of a message trace (message_id, sender, recipient, sec) that the corpus lacks."""
    def bare(c: str) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.col(c), "[<>]", "")))

    have = messages.select(bare("message_id").alias("id")).distinct()
    out = trace.filter(F.lower("sender").isin([s.lower() for s in senders]) & (F.col("sec") >= since_sec)).withColumn("id", bare("message_id"))
    return out.join(have, "id", "left_anti").select("id", "sender", "recipient", "sec")


def notification_scope(trace: DataFrame, internal: DataFrame) -> DataFrame:
    """domain, recipients, messages: external domains that got mail. trace: message, recipient, recipient_domain."""
    ext = trace.join(internal.select(F.col("domain").alias("recipient_domain")), "recipient_domain", "left_anti")
    return ext.filter("recipient_domain <> ''").groupBy(F.col("recipient_domain").alias("domain")).agg(F.count_distinct("recipient").alias("recipients"), F.count_distinct("message").alias("messages"))
