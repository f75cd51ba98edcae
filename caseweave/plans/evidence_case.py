"""What an evidence folder adds to a case: persistence, configuration drift, outbound mail, the directory, audit settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import config as C
from caseweave.functions.address import domain_of
from caseweave.operators import audit as A
from caseweave.operators import baseline as B
from caseweave.operators import enrich as E
from caseweave.operators import identity as I
from caseweave.operators import joins as J
from caseweave.operators import scenario as S

# States of a message trace in which a message has reached its recipient.
DELIVERED = ("delivered", "resolved", "expanded")


def recorded_rules(events: DataFrame) -> DataFrame:
    """The inbox rules that an audit log saw made: ip, name, forwards, words, move_to, conceals, mark_read, stop. events: op_lower,
    ip, parameters."""
    params = F.col("parameters")
    p = lambda k: F.coalesce(F.try_element_at(params, F.lit(k)), F.lit(""))
    forwards = F.array_distinct(F.transform(F.flatten(F.array(*[F.regexp_extract_all(p(k), F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"), F.lit(1)) for k in ("forwardto", "redirectto", "forwardasattachmentto", "forwardingsmtpaddress", "forwardingaddress")])), F.lower))
    listed = F.flatten(F.array(*[F.split(F.lower(p(k)), "[;,]") for k in ("subjectcontainswords", "bodycontainswords", "subjectorbodycontainswords", "fromaddresscontainswords")]))
    words = F.filter(F.transform(listed, lambda w: F.regexp_replace(F.trim(w), "^[\"']+|[\"']+$", "")), lambda w: w != "")
    hidden = F.lower(p("movetofolder")).rlike("rss|archive|junk|deleted|conversation history|notes") | I.truthy(p("deletemessage"))
    return events.filter(A.one_of("op_lower", C.RULE_OPS)).select("ip", p("name").alias("name"), forwards.alias("forwards"), words.alias("words"), p("movetofolder").alias("move_to"), hidden.alias("conceals"), I.truthy(p("markasread")).alias("mark_read"), I.truthy(p("stopprocessingrules")).alias("stop"))


def accepted_domains(sources: dict[str, DataFrame]) -> tuple[str, ...]:
    """The tenant's own domains. A tenant can't have more than 5,000; an export with more is refused."""
    if "domains" not in sources:
        return ()
    found = [r.domain for r in sources["domains"].select("domain").distinct().orderBy("domain").limit(5001).collect()]
    if len(found) > 5000:
        raise ValueError("no tenant has over 5,000 accepted domains: is this another export?")
    return tuple(found)


def outbound(trace: DataFrame, messages: DataFrame, mailboxes: tuple[str, ...], attacker_ips: tuple[str, ...], since_sec: int | None, internal: DataFrame) -> dict[str, DataFrame]:
    """Of a message trace: trace_gap (sent by the mailboxes since, and not in the corpus), attacker_sent (those from the attacker's
    addresses, by status) and notification (external domains that got mail). mailboxes: the victims' addresses."""
    since = -(1 << 40) if since_sec is None else since_sec
    own = trace.filter(A.one_of("sender", tuple(m.lower() for m in mailboxes)) & (F.lit(since_sec is None) | (F.col("sec") >= since)))
    state = own.filter(A.one_of("from_ip", attacker_ips)).groupBy("from_ip", "status").agg(F.count("*").alias("messages"), F.count_distinct("recipient").alias("recipients"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    reached = own.filter(F.col("status").isin(*DELIVERED)).withColumn("message", F.col("message_id"))
    return {"trace_gap": J.trace_gap(trace, messages, mailboxes, since), "attacker_sent": state, "notification": J.notification_scope(reached, internal)}


def drift(sources: dict[str, DataFrame], recorded: DataFrame | None, internal: tuple[str, ...]) -> DataFrame | None:
    """Rules, transport rules and delegations of the configuration that no log explains, as actions for the remediation plan;
    None if no such export is there. Without an audit log nothing is explained."""
    some = next((sources[k] for k in ("rules", "transport", "permissions") if k in sources), None)
    if some is None:
        return None
    make = some.sparkSession.createDataFrame
    log = recorded if recorded is not None else make([], "name string, forwards array<string>, words array<string>, move_to string")
    rules = E.config_drift(sources["rules"], log.select("name", "forwards", "words", "move_to"), internal) if "rules" in sources else make([], "name string, external boolean")
    transport = sources["transport"].select("name", "redirects") if "transport" in sources else make([], "name string, redirects array<string>")
    granted = E.delegations(I.mailbox_permissions(sources["permissions"]), internal) if "permissions" in sources else make([], "mailbox string, user string, external boolean")
    return I.drift_actions(rules, transport, granted)


ACTION = ("kind", "target", "by_attacker", "password", "sec", "source")


def analyze(sources: dict[str, DataFrame], messages: DataFrame, anchors: S.Anchors, victim_domains: tuple[str, ...], audit: DataFrame | None, containment_sec: int | None = None) -> dict[str, DataFrame]:
    """Frames by name, of the exports that are there (sources: kind to frame, as sources.evidence.collect() reads them).

    persistence, remediation, drift, rule_cleanup, trace_gap, attacker_sent, notification, impersonation, directory,
    audit_status, delegates. The mailbox of the case is the one that most messages were sent to."""
    out: dict[str, DataFrame] = {}
    own = tuple(dict.fromkeys((*(v.lower() for v in victim_domains), *accepted_domains(sources))))
    box = messages.select(F.explode("recipients").alias("r")).groupBy(F.lower("r").alias("r")).count().orderBy(F.desc("count"), "r").limit(1).collect()
    mailboxes = tuple(dict.fromkeys((*(v.lower() for v in anchors.victims), *(r.r for r in box))))
    recorded = recorded_rules(audit) if audit is not None else None

    events = [make(sources[k]) for k, make in (("entra_audit", I.directory_audit), ("oauth", I.oauth_grants)) if k in sources]
    actions = []
    if events:
        both = events[0] if len(events) == 1 else events[0].unionByName(events[1])
        out["persistence"] = I.persistence(both, anchors.attacker_ips, anchors.compromise_sec, containment_sec, (*mailboxes, *(f"@{d}" for d in victim_domains)))
        actions.append(out["persistence"].select(*ACTION))
    unexplained = drift(sources, recorded, own)
    if unexplained is not None:
        out["drift"] = unexplained
        actions.append(unexplained.select(*ACTION))
    if actions:
        out["remediation"] = I.remediation_plan(actions[0] if len(actions) == 1 else actions[0].unionByName(actions[1]))
    if recorded is not None and "rules" in sources:
        removed = audit.filter("op_lower = 'remove-inboxrule'").select(F.coalesce(F.try_element_at("parameters", F.lit("identity")), F.try_element_at("parameters", F.lit("name"))).alias("name"))
        created = audit.filter("op_lower = 'new-inboxrule'").select(F.try_element_at("parameters", F.lit("name")).alias("name"))
        out["rule_cleanup"] = A.rule_cleanup(created, sources["rules"], removed)
    if "trace" in sources:
        out |= outbound(sources["trace"], messages, mailboxes, anchors.attacker_ips, anchors.compromise_sec, _internal(messages, own))
    if "users" in sources:
        out["impersonation"] = I.impersonation(messages, I.directory_users(sources["users"]))
        domains = sources["domains"] if "domains" in sources else messages.sparkSession.createDataFrame([], "domain string")
        out["directory"] = I.directory_stats(sources["users"], domains)
    if "audit_status" in sources:
        out["audit_status"] = I.audit_status(sources["audit_status"], mailboxes[0] if mailboxes else "")
    if audit is not None and "permissions" in sources:
        known = I.mailbox_permissions(sources["permissions"]).select(F.lower("user").alias("principal")).distinct().withColumn("holds", F.lit(True))
        found = A.delegate_access(audit, (), anchors.attacker_ips).drop("known_delegate")
        out["delegates"] = found.join(known, "principal", "left").withColumn("known_delegate", F.coalesce("holds", F.lit(False))).drop("holds")
    return out


def _internal(messages: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """domain: the tenant's own ones, else those that the corpus shows to be internal."""
    if own:
        return messages.sparkSession.createDataFrame([(d,) for d in own], "domain string")
    pairs = messages.select("sender_domain", F.explode_outer("recipients").alias("r")).withColumn("recipient_domain", domain_of(F.col("r")))
    return B.internal_domains(pairs, "recipient_domain")


def answers(frames: dict[str, DataFrame], anchors: S.Anchors) -> dict[str, DataFrame]:
    """One row (text) or a few for each question of scenario.case_page() that the frames of a case can answer."""
    def one(df: DataFrame, text: Column, *counts: Column) -> DataFrame:
        return df.agg(*counts).select(F.coalesce(text, F.lit("")).alias("text"))

    n = F.col("n").cast("string")
    spark = frames["verdict"].sparkSession
    out = {"entry": frames["verdict"].select(F.concat(F.col("path"), F.lit(" ("), F.col("confidence"), F.lit(" confidence)")).alias("text"))}
    if anchors.compromise_sec is not None:
        out["when"] = spark.range(1).select(F.date_format(F.timestamp_seconds(F.lit(anchors.compromise_sec)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"))
    if anchors.scenario:
        out["how"] = spark.range(1).select(F.lit({"ato": "account takeover"}.get(anchors.scenario, anchors.scenario)).alias("text"))
    count = F.count("*").alias("n")
    if "ip_activity" in frames and anchors.attacker_ips:
        out["access"] = spark.range(1).select(F.lit(f"from {len(anchors.attacker_ips)} addresses").alias("text"))
    if "exposure" in frames:
        bound = F.when(F.col("low"), " at least").otherwise("")
        out["read"] = one(frames["exposure"], F.when(F.col("n") > 0, F.concat(n, F.lit(" messages read"), bound)), count, F.coalesce(F.bool_or("lower_bound"), F.lit(False)).alias("low"))
    if "file_activity" in frames:
        out["taken"] = frames["file_activity"].select(F.when(F.col("exfil_files") > 0, F.concat(F.col("exfil_files").cast("string"), F.lit(" files"))).otherwise("").alias("text"))
    if "persistence" in frames:
        his = F.count_if("by_attacker").alias("his")
        out["persistence"] = one(frames["persistence"], F.when(F.col("n") > 0, F.concat(n, F.lit(" changes outlast the session, "), F.col("his").cast("string"), F.lit(" of them the attacker's"))), count, his)
    if "notification" in frames:
        out["notified"] = one(frames["notification"], F.when(F.col("n") > 0, F.concat(F.col("r").cast("string"), F.lit(" recipients in "), n, F.lit(" external domains"))), count, F.sum("recipients").alias("r"))
    if "coverage_warnings" in frames:
        out["limits"] = frames["coverage_warnings"].select("text")
    return out


def story(frames: dict[str, DataFrame], messages: DataFrame, audit: DataFrame | None, anchors: S.Anchors) -> DataFrame:
    """scenario.narrative() of a case: the verdict's message, the attacker's first event of each address, what lasts, and
    what was sent or destroyed (a row for each address and operation)."""
    none = messages.sparkSession.createDataFrame([], "sec long, ref string, what string")
    entry = messages.join(frames["verdict"].select("path"), "path", "left_semi").select("sec", F.col("path").alias("ref"), F.concat_ws(": ", "sender", "subject").alias("what"))
    access = impact = lasting = none
    if audit is not None:
        mine = audit.filter(A.one_of("ip", anchors.attacker_ips))
        access = mine.groupBy(F.col("ip").alias("ref")).agg(F.min("sec").alias("sec"), F.count("*").alias("n")).select("sec", "ref", F.concat(F.col("n").cast("string"), F.lit(" events")).alias("what"))
        impact = mine.filter(A.one_of("op_lower", (*C.SEND_OPS, *C.DELETE_OPS))).groupBy("ip", "op").agg(F.min("sec").alias("sec"), F.count("*").alias("n")).select("sec", F.col("ip").alias("ref"), F.concat(F.col("op"), F.lit(" x "), F.col("n").cast("string")).alias("what"))
    if "persistence" in frames:
        lasting = I.timeline_rows(frames["persistence"].filter("by_attacker")).select("sec", "ref", "what")
    return S.narrative(entry, access, lasting, impact)
