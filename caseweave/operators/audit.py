"""Operators over a normalised audit log: event_id, sec, actor, op, op_lower, ip, session_id, client_info, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave import config as C


def one_of(col: str, values: tuple[str, ...]) -> Column:
    """Membership, false for null."""
    return F.coalesce(F.col(col).isin(*values), F.lit(False))


def top_values(df: DataFrame, keys: list[str], value: str, seq: str, k: int, alias: str) -> DataFrame:
    """keys and alias: the k most frequent values as `value:n` joined by commas, ties by first appearance (seq)."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    top = n.withColumn("r", rank).filter(F.col("r") <= k)
    item = F.struct("r", F.concat_ws(":", value, F.col("n").cast("string")).alias("v"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]), ",").alias(alias))


def session_rollup(events: DataFrame, attacker_ips: tuple[str, ...], compromise_sec: int) -> DataFrame:
    """One row for each logon session: addresses, span, counts by kind of operation, the five most frequent operations
    and the most frequent client. Events without a session are left out. Sessions that touch an attacker's address
    say so."""
    e = events.filter(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
    rolled = e.groupBy("session_id").agg(
        F.min_by("actor", F.struct("sec", "event_id")).alias("user"),
        F.count_distinct("ip").alias("ips"),
        F.bool_or(one_of("ip", attacker_ips)).alias("is_attacker"),
        F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"),
        F.expr("(max(us) - min(us)) div 60000000").alias("minutes"),
        F.count("*").alias("events"),
        F.count_if(F.col("op_lower") == "mailitemsaccessed").alias("reads"),
        *[F.count_if(one_of("op_lower", ops)).alias(n) for n, ops in (("deletes", C.DELETE_OPS), ("sends", C.SEND_OPS), ("rules", C.RULE_OPS), ("files", C.FILE_OPS))],
    )
    clients = top_values(e.filter("client_info <> ''"), ["session_id"], "client_info", "event_id", 1, "client")
    ops = top_values(e, ["session_id"], "op", "event_id", 5, "top_operations")
    out = rolled.join(ops, "session_id", "left").join(clients, "session_id", "left")
    return out.withColumns({"rotated": F.col("ips") > 1, "post_compromise": F.col("first_sec") >= compromise_sec, "client": F.coalesce(F.regexp_replace("client", ":[0-9]+$", ""), F.lit(""))})


def session_widening(events: DataFrame, attacker_ips: tuple[str, ...], owner_ips: tuple[str, ...] = ()) -> DataFrame:
    """ip: addresses that share a session with an attacker's address and are neither his nor the owner's. One hop."""
    with_session = events.filter("session_id <> '' AND ip <> ''").select("session_id", "ip")
    hit = with_session.filter(one_of("ip", attacker_ips)).select("session_id").distinct()
    return with_session.join(hit, "session_id", "left_semi").filter(~one_of("ip", (*attacker_ips, *owner_ips))).select("ip").distinct()


def ip_activity(events: DataFrame, attacker_ips: tuple[str, ...], key: str = "ip", k: int = 8) -> DataFrame:
    """For each address: events, users, span, the k most frequent operations, and whether it is the attacker's."""
    e = events.filter(F.col(key) != "")
    rolled = e.groupBy(key).agg(F.count("*").alias("events"), F.count_distinct("actor").alias("users"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    return rolled.join(top_values(e, [key], "op", "event_id", k, "operations"), key).withColumn("is_attacker", one_of(key, attacker_ips))


def client_class(info: Column) -> Column:
    """system, powershell, ews, activesync, mobile, owa, desktop, rest or other, by the first that fits; unknown if empty."""
    s = F.lower(F.coalesce(info, F.lit("")))
    out = F.when(s == "", "unknown")
    for name, needles in C.CLIENT_CLASSES:
        fits = s.contains(needles[0])
        for n in needles[1:]:
            fits |= s.contains(n)
        out = out.when(fits, name)
    return out.otherwise("other")


def client_profile(events: DataFrame, attacker_ips: tuple[str, ...]) -> DataFrame:
    """For each address: its client classes, and whether a person's client, or only the service itself, used it."""
    e = events.filter("ip <> ''").withColumn("class", client_class(F.col("client_info")))
    return e.groupBy("ip").agg(
        F.count("*").alias("events"), F.array_join(F.sort_array(F.collect_set("class")), ",").alias("classes"),
        F.bool_or(~F.col("class").isin("system", "unknown")).alias("person_client"),
        (F.bool_and(F.col("class").isin("system", "unknown")) & F.bool_or(F.col("class") == "system")).alias("system_only"),
    ).withColumn("is_attacker", one_of("ip", attacker_ips))


def access_profile(reads: DataFrame, attacker_ips: tuple[str, ...]) -> DataFrame:
    """Reads by how they were made (access_type sync, bind or other; throttled), for all and for the attacker: one scan
    with grouping sets."""
    r = reads.withColumn("atk", one_of("ip", attacker_ips))
    out = r.groupingSets([[], ["atk"]], "atk").agg(
        F.grouping("atk").alias("g"), F.count("*").alias("events"), F.count_if(F.col("access_type") == "sync").alias("sync"), F.count_if(F.col("access_type") == "bind").alias("bind"),
        F.count_if(~F.coalesce(F.col("access_type"), F.lit("")).isin("sync", "bind")).alias("untyped"), F.count_if("throttled").alias("throttled"), F.min(F.when(F.col("throttled"), F.col("sec"))).alias("throttled_first"),
    )
    return out.filter("g = 1 OR atk").select(F.when(F.col("g") == 1, "all").otherwise("attacker").alias("who"), "events", "sync", "bind", "untyped", "throttled", "throttled_first")


def delegate_access(events: DataFrame, known: tuple[str, ...], attacker_ips: tuple[str, ...]) -> DataFrame:
    """Principals that worked in a mailbox of another owner under delegated rights (logon_type 2)."""
    d = events.filter("logon_type = 2 AND actor <> '' AND lower(actor) <> lower(coalesce(mailbox_owner, ''))").withColumn("principal", F.lower("actor"))
    return d.groupBy("principal").agg(
        F.count("*").alias("events"), F.count_distinct("mailbox_owner").alias("mailboxes"), F.count_distinct("op").alias("operations"), F.count_distinct("ip").alias("ips"),
        F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), F.bool_or(one_of("ip", attacker_ips)).alias("from_attacker_ip"),
    ).withColumn("known_delegate", one_of("principal", tuple(k.lower() for k in known)))


def file_activity(events: DataFrame, attacker_ips: tuple[str, ...], object_col: str = "object_id") -> DataFrame:
    """One row: file events, those from the attacker's addresses, what was taken and what was shared."""
    f = events.filter(one_of("op_lower", C.FILE_OPS)).withColumn("atk", one_of("ip", attacker_ips)).withColumn("exfil", F.col("atk") & one_of("op_lower", C.EXFIL_OPS))
    return f.agg(
        F.count("*").alias("total"), F.count_if("atk").alias("attacker_events"), F.count_if("exfil").alias("exfil"), F.count_distinct(F.when(F.col("exfil"), F.col(object_col))).alias("exfil_files"),
        F.count_if(F.col("atk") & one_of("op_lower", C.SHARE_OPS)).alias("shared"), F.count_if(F.col("exfil") & (F.col("op_lower") == "filesyncdownloadedfull")).alias("full_sync"),
    )


def coverage(events: DataFrame) -> DataFrame:
    """One row: what the export spans."""
    return events.agg(
        F.count("*").alias("events"), F.count_if(F.col("sec").isNull()).alias("without_time"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"),
        F.expr("(max(sec) - min(sec)) div 86400").alias("span_days"), F.count_distinct("op").alias("operations"), F.count_distinct("actor").alias("mailboxes"), F.count_distinct("ip").alias("ips"),
    )


def coverage_warnings(cover: DataFrame, corpus_first: int, corpus_last: int, compromise: int, lookback_days: int) -> DataFrame:
    """severity and text of what the export can't support; no rows if nothing limits it."""
    day = F.lit(86400)
    seen = F.col("events") > 0
    timed = seen & F.col("first_sec").isNotNull()
    rules = [
        (~seen, "high", F.lit("no audit events were parsed")),
        (seen & F.col("first_sec").isNull(), "high", F.lit("no event carries a time")),
        (timed & (F.col("without_time") > 0), "medium", F.concat(F.col("without_time"), F.lit(" events carry no time"))),
        (timed & (F.lit(corpus_first) < F.col("first_sec")), "high", F.concat(F.lit("corpus begins "), F.floor((F.col("first_sec") - corpus_first) / day).cast("string"), F.lit(" days before the log"))),
        (timed & (F.lit(corpus_last) > F.col("last_sec")), "medium", F.concat(F.lit("log ends "), F.floor((F.lit(corpus_last) - F.col("last_sec")) / day).cast("string"), F.lit(" days before the corpus"))),
        (timed & (F.lit(compromise) - F.col("first_sec") <= 86400), "high", F.lit("compromise falls in the first day of the log")),
        (timed & (F.col("span_days") < lookback_days), "medium", F.concat(F.lit("log spans "), F.col("span_days").cast("string"), F.lit(f" of {lookback_days} days"))),
    ]
    made = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), t.alias("text"))) for c, s, t in rules])
    return cover.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("w")).select("w.*")


def rule_republish(rules: DataFrame) -> DataFrame:
    """event_id, fingerprint and repeated: whether the same rule was published at an earlier time."""
    before = Window.partitionBy("fingerprint").orderBy(F.asc_nulls_last("us"), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rules.select("event_id", "fingerprint", (F.count("*").over(before) > 0).alias("repeated"))


def search_intent(searches: DataFrame, terms: tuple[str, ...], attacker_ips: tuple[str, ...]) -> DataFrame:
    """event_id, intent (the terms a query contains, in their order), by_attacker: of searches with text."""
    q = F.lower(F.trim("query"))
    intent = F.filter(F.array(*[F.when(q.contains(t), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return searches.filter("trim(query) <> ''").select("event_id", F.array_join(intent, ",").alias("intent"), one_of("ip", attacker_ips).alias("by_attacker"))


def rule_cleanup(created: DataFrame, current: DataFrame, removed: DataFrame) -> DataFrame:
    """name, creations and removal_logged: rules created in the log (name) that the configuration (name) lacks now."""
    key = F.lower(F.trim("name")).alias("name")
    made = created.select(key).filter("name <> ''").groupBy("name").agg(F.count("*").alias("creations"))
    gone = made.join(current.select(key), "name", "left_anti")
    logged = removed.select(key).distinct().withColumn("logged", F.lit(True))
    return gone.join(logged, "name", "left").select("name", "creations", F.coalesce("logged", F.lit(False)).alias("removal_logged"))


def subject_senders(events: DataFrame, subjects: tuple[str, ...], since_sec: int | None = None) -> DataFrame:
    """ip, sends: addresses that sent a message under a subject that the investigator says is the attacker's, from the
    compromise on (an unknown time counts). events: op_lower, sec, ip, subjects (array)."""
    from caseweave.functions.text import normalize_subject

    wanted = F.array(*[normalize_subject(F.lit(s)) for s in subjects if s.strip()]) if any(s.strip() for s in subjects) else F.array().cast("array<string>")
    sent = events.filter(one_of("op_lower", C.SEND_OPS) & (F.lit(True) if since_sec is None else F.coalesce(F.col("sec") >= since_sec, F.lit(True))))
    hit = sent.filter(F.arrays_overlap(F.transform("subjects", normalize_subject), wanted))
    return hit.filter("ip <> ''").groupBy("ip").agg(F.count("*").alias("sends"))
