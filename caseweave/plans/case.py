"""A whole case: mail and logs in, scored and tiered messages, verdict, indicators and timeline out. All frames are lazy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import config as C
from caseweave.checkpoint import materialize
from caseweave.functions import auth, files, text, url
from caseweave.functions.address import domain_of, normalize_email, registrable_domain
from caseweave.operators import audit as A
from caseweave.operators import baseline as B
from caseweave.operators import body as X
from caseweave.operators import campaigns as K
from caseweave.operators import enrich as E
from caseweave.operators import graph as G
from caseweave.operators import identity as I
from caseweave.operators import joins as J
from caseweave.operators import report as Q
from caseweave.operators import rollups as R
from caseweave.operators import scenario as S
from caseweave.operators import scoring as P
from caseweave.operators import threads as T
from caseweave.plans import evidence_case as V
from caseweave.plans import signin_case as N

# Mail hosts that anyone can use.
FREE_MAIL = ("gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "aol.com", "icloud.com", "proton.me", "protonmail.com")


@dataclass
class Case:
    """What a case gives: frames by name."""

    anchors: S.Anchors
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.frames[name]
        except KeyError:
            raise AttributeError(name) from None


def attribute(events: DataFrame, anchors: S.Anchors, owner_ips: tuple[str, ...] = (), owners: DataFrame | None = None) -> S.Anchors:
    """Anchors with the attacker's addresses and the time of the compromise that the audit log gives.

    In this order: addresses that made suspicious rules, and those given; less the owner's; and those that share a session with
    them, once. The addresses of one attacker are a few, and become literals; owners (ip: addresses that owners' devices vouch
    for, any number) are only asked about those."""
    r = V.recorded_rules(events.filter("ip <> ''"))
    odd = (F.length(F.trim("name")) <= 2) & (F.trim("name") != "") & ~F.trim("name").rlike("[A-Za-z0-9]{2}")
    bad = r.filter((F.size("forwards") > 0) | F.col("conceals") | (F.size("words") > 0) | odd | ((F.col("mark_read") | F.col("stop")) & (F.col("move_to") != "")))
    keywords = tuple(sorted(w.word for w in bad.select(F.explode("words").alias("word")).distinct().collect()))
    ips = {x.ip for x in bad.select("ip").distinct().collect()} | set(anchors.attacker_ips)
    ips -= _vouched(ips, owner_ips, owners)
    known = tuple(sorted(ips))
    if known:
        wider = {x.ip for x in A.session_widening(events, known, owner_ips).collect()}
        ips |= wider - _vouched(wider, owner_ips, owners)
    known = tuple(sorted(ips))
    first = events.filter(A.one_of("ip", known)).agg(F.min("sec")).first()[0] if known else None
    return anchors.merged(S.Anchors(attacker_ips=known, compromise_sec=first, rule_keywords=keywords, scenario="ato" if first is not None else ""))


def _vouched(ips: set[str], owner_ips: tuple[str, ...], owners: DataFrame | None) -> set[str]:
    """Those of a few addresses that are their owner's."""
    said = set(owner_ips)
    if owners is not None and ips:
        said |= {r.ip for r in owners.filter(A.one_of("ip", tuple(sorted(ips)))).distinct().collect()}
    return ips & said


def _term_rules(messages: DataFrame, cap: float) -> list[P.Rule]:
    """A rule for each phrase, its weight lowered where the phrase is common in this corpus: one pass counts all phrases."""
    low = F.concat_ws("\n", "subject", "body")
    terms = list(C.PHISHING_TERMS.items())
    share_of = {r.term: r.hits / r.n if r.n else 0.0 for r in B.term_frequencies(messages, low, tuple(C.PHISHING_TERMS)).collect()}
    aware = S.any_of(low, C.NEGATIVE_CONTEXT)
    rules = []
    for t, w in terms:
        share = share_of[t]
        scaled = round(w * cap / share) if share > cap else w
        rules.append((f"Phrase: {t}", "language", "body", text.term_present(low, t), F.when(aware, 0).otherwise(scaled) if t in C.CONTEXT_SENSITIVE_TERMS else F.lit(scaled)))
    return rules


def _has(flag: str) -> Column:
    return F.exists("attachments", lambda a: F.array_contains(a["flags"], flag))


def base_rules(messages: DataFrame, t: C.Thresholds, allowlist: tuple[str, ...] = ()) -> list[P.Rule]:
    """The additive rules over messages as caseweave.sources.mail gives them.

    Odd Received chains and dates of senders in allowlist (registrable domains) don't count, unless authentication fails or
    answers go elsewhere: a spoof of a trusted sender stays visible."""
    risk = F.least(F.lit(12), F.aggregate(F.transform("urls", url.risk_score), F.lit(0), lambda a, x: a + x))
    body = F.concat_ws("\n", "subject", "body")
    pay, hurry = S.any_of(body, S.PAYMENT_TERMS), S.any_of(body, S.URGENCY_TERMS)
    reply = domain_of(normalize_email(F.col("reply_to")))
    received = auth.received_anomaly(F.col("received"), F.lit(True))
    astray = (reply != "") & (F.col("sender_domain") != "") & (registrable_domain(reply) != registrable_domain(F.col("sender_domain")))
    trusted = registrable_domain(F.col("sender_domain")).isin(*[a.lower() for a in allowlist]) if allowlist else F.lit(False)
    quiet = trusted & (F.col("auth_state") != "failed") & ~astray
    risky_archive = F.exists("attachments", lambda a: files.extension(a["filename"]).isin(*files.ARCHIVE)) & F.exists("attachments", lambda a: F.arrays_overlap(a["flags"], F.array(*[F.lit(x) for x in files.RISKY_FLAGS])))
    return [
        ("Free-mail sender", "sender", "header:From", F.col("sender_domain").isin(*FREE_MAIL), 3), *_term_rules(messages, t.phrase_cap), ("Risky links", "url", "body", risk > 0, risk),
        ("Link to an IP address", "url", "body", F.exists("urls", lambda u: url.is_ip(url.parts(u)["host"])), 6), ("Attachment: disguised executable", "attachment", "attachment", _has("disguised executable"), 8), ("Attachment does not match the extension", "attachment", "attachment", _has("content does not match the extension"), 6),
        ("Attachment: executable", "attachment", "attachment", _has("executable extension"), 8), ("Attachment: archive with a risky item", "attachment", "attachment", risky_archive, 5), ("Attachment: credential form", "attachment", "attachment", _has("credential form"), 6), ("Attachment: undeclared macro", "attachment", "attachment", _has("embedded macro") & ~_has("macro extension"), 4), ("Attachment: macro", "attachment", "attachment", _has("macro extension"), 4), ("Attachment: deceptive name", "attachment", "attachment", _has("double extension") | _has("right-to-left name"), 5), ("Attachment: web page", "attachment", "attachment", _has("web page"), 2),
        ("Payment and urgency", "language", "body", pay & hurry, 5), ("Reply-To differs from sender domain", "identity", "header:Reply-To", astray, 5),
        ("Received chain anomaly", "headers", "header:Received", received.isin("missing", "single hop") & ~quiet, 2), ("Date in the future", "headers", "header:Date", (auth.date_anomaly(F.col("date_raw"), F.col("date_ts"), F.col("arrival_ts")) == "future") & ~quiet, 2),
        ("Hidden link in base64", "url", "body", F.size(files.base64_urls(F.col("body"))) > 0, 6), ("Bulk mail", "sender", "header:List-Unsubscribe", F.col("bulk_mail"), -3),
    ]


def investigate(messages: DataFrame, anchors: S.Anchors | None = None, audit: DataFrame | None = None, owner_ips: tuple[str, ...] = (), t: C.Thresholds = C.DEFAULTS, victim_domains: tuple[str, ...] = (), signins: DataFrame | None = None, persistence: DataFrame | None = None, evidence: dict[str, DataFrame] | None = None, allowlist: tuple[str, ...] = (), containment_sec: int | None = None, lure_window_sec: int = 1200) -> Case:
    """A case from messages (as caseweave.sources.mail reads them) and, if there, an audit log and sign-ins (as
    caseweave.sources.exports reads them), and persistence events (identity.persistence).

    Frames: findings, scores, threads, campaigns, campaign_indicators, message_events, tiers, verdict, shortlist, iocs,
    timeline, statistics; of an audit log also sessions, ip_activity, exposure, deleted, completeness; of sign-ins those of
    signin_case.analyze() under signin_ names; of persistence events remediation; of evidence (kind to frame, as
    sources.evidence.collect() reads exports) those of evidence_case.analyze(). Always narrative and case_page.

    allowlist: registrable domains, as base_rules() takes them. Events of the audit log from
    containment_sec on are the responders', and name no attacker."""
    anchors = anchors or S.Anchors()
    if audit is not None:
        audit = materialize(audit.withColumns({"us": F.col("sec") * 1_000_000, "event_id": F.monotonically_increasing_id()}))
        owners = I.owner_addresses(signins, evidence["devices"]) if signins is not None and evidence and "devices" in evidence else None
        acted = audit if containment_sec is None else audit.filter((F.col("sec") < containment_sec) | F.col("sec").isNull())
        anchors = attribute(acted, anchors, owner_ips, owners)
        if anchors.subjects:  # who sent what the investigator names is the attacker too: a few addresses
            more = tuple(r.ip for r in A.subject_senders(acted, anchors.subjects, anchors.compromise_sec).collect() if r.ip not in owner_ips)
            anchors = anchors.merged(S.Anchors(attacker_ips=more))
    timed = messages.withColumns({"sec": F.unix_seconds("arrival_ts"), "day": F.floor(F.unix_seconds("arrival_ts") / 86400), "sender": F.col("sender_email")})
    m = materialize(X.prepare_bodies(timed, anchors.compromise_sec // 86400 if anchors.compromise_sec is not None else None, t))
    out: dict[str, DataFrame] = {"messages": m}

    base = materialize(P.findings(m, base_rules(m, t, allowlist)))
    summed = P.scores(m, base)
    domains = B.domain_baseline(m.withColumn("auth", F.when(F.col("auth_state").isin("aligned", "partial"), "pass").when(F.col("auth_state") == "failed", "fail")), t)
    d = domains.select(F.col("sender_domain").alias("d"), "n", "auth_seen", "auth_pass", "enforces", "established", "first_contact", "frequent")
    rich = m.join(summed, "path").join(d, F.col("sender_domain") == F.col("d"), "left").withColumn("state", F.col("auth_state"))
    modified = materialize(P.baseline_modifiers(rich, t))

    ids = m.select(F.col("message_id").alias("id"), F.coalesce(F.nullif("in_reply_to", F.lit("")), F.try_element_at("references", F.lit(-1))).alias("parent")).filter("id <> ''").dropDuplicates(["id"])
    roots = G.thread_roots(ids)
    threads = m.select("path", "message_id").join(roots, m["message_id"] == roots["id"], "left").select("path", F.coalesce("root", F.concat(F.lit("file:"), "path")).alias("thread"), "steps")
    body = F.concat_ws("\n", "subject", "body")
    login, pay = S.any_of(body, S.CREDENTIAL_LURES), S.any_of(body, S.PAYMENT_TERMS)
    in_thread = modified.select("path", F.col("final").alias("score"), "sec", "day", "sender", "sender_domain", login.alias("login"), pay.alias("pay"), "message_id").join(threads, "path")
    pre = T.precursors(in_thread, "sec")
    newcomer = T.new_participants(in_thread.withColumn("sender", F.col("sender_domain")), "sec")
    scored = materialize(modified.drop("score").withColumnRenamed("final", "base_score").join(pre.select("path", "thread", "bonus", "likely_precursor"), "path").join(newcomer.select("path", F.col("new").alias("thread_injection")), "path").withColumn("score", F.col("base_score") + F.col("bonus")))
    out |= {"findings": base, "baseline": domains, "threads": threads, "scores": scored.select("path", "score", "base_score", "bonus", "likely_precursor", "thread")}

    hits = S.anchor_matches(scored, anchors)
    victims = tuple(v.lower() for v in victim_domains)
    inbound = ~F.col("sender_domain").isin(*victims) if victims else F.lit(True)
    folder = auth.folder_hint(F.col("path"))
    flags = {
        "self_spoofing": A.one_of("sender_domain", victims) & (F.col("auth_state") == "failed"), "auth_anomaly": F.coalesce(F.col("enforces"), F.lit(False)) & (F.col("auth_state") == "failed"), "lookalike": F.lit(False), "reply_to_mismatch": (domain_of(normalize_email(F.col("reply_to"))) != "") & (domain_of(normalize_email(F.col("reply_to"))) != F.col("sender_domain")),
        "deleted": folder == "deleted", "moved": folder == "moved", "rule_target": S.any_of(body, anchors.rule_keywords) if anchors.rule_keywords else F.lit(False),
        "attachment_credential": _has("credential form"), "attachment_other": F.size(files.threat_notes(F.col("attachments"))) > 0, "login_url": F.exists("urls", lambda u: url.risk_rules(u)["auth_path"][0]), "has_url": F.size("urls") > 0, "first_contact": F.coalesce("first_contact", F.lit(False)), "established": F.coalesce("established", F.lit(False)),
    }
    lookalike = _lookalikes(domains, victims, m, t)
    f = scored.withColumns({**flags, "inbound": inbound | A.one_of("sender_domain", victims) & (F.col("auth_state") == "failed"), "text": body, "anchors": F.size(hits)}).drop("lookalike").join(lookalike, "sender_domain", "left").withColumn("lookalike", F.coalesce("lookalike", F.lit(False)))
    internal = B.internal_domains(m.select("sender_domain", F.explode_outer("recipients").alias("r")).withColumn("recipient_domain", domain_of(F.col("r"))), "recipient_domain", t) if not victims else m.sparkSession.createDataFrame([(v,) for v in victims], "domain string")
    odd_ip = B.sending_ip_anomaly(m.select(F.col("sender").alias("actor"), F.col("origin_ip").alias("ip"))).select(F.col("actor").alias("odd_sender"), F.col("ip").alias("odd_ip"))
    f = f.join(odd_ip, (F.col("sender") == F.col("odd_sender")) & (F.col("origin_ip") == F.col("odd_ip")), "left").withColumn("sending_ip_anomaly", F.col("odd_ip").isNotNull()).drop("odd_sender", "odd_ip")
    f = _flagged(f, E.display_name_spoof(m, internal), "display_name_spoof")
    day = anchors.compromise_sec // 86400 if anchors.compromise_sec is not None else 1 << 40
    files_of = m.join(threads.select("path", "thread"), "path").select("path", "thread", "day", "sender", F.col("sender_domain").alias("domain"), F.explode("attachments").alias("a"))
    swapped = J.attachment_substitution(files_of.select("path", "thread", "day", "sender", "domain", files.attachment_key(F.col("a.filename")).alias("name"), F.col("a.sha256").alias("sha")).filter("name <> ''"), day)
    f = _flagged(f, swapped.filter("indicated"), "substituted")
    takeover = anchors.scenario == "ato" or anchors.compromise_sec is not None
    f = f.withColumn("scenario_score", S.initial_score(f, takeover, anchors))
    if audit is not None:
        exploded = audit.select("*", F.explode_outer("message_ids").alias("message_id"))
        ev = J.message_events(m, exploded, anchors.attacker_ips)
        reads = exploded.filter("op_lower = 'mailitemsaccessed'").withColumns({"access_type": F.lower(F.coalesce(F.try_element_at("parameters", F.lit("mailaccesstype")), F.lit(""))), "throttled": I.truthy(F.try_element_at("parameters", F.lit("isthrottled")))})
        deleted = J.deleted_absent(exploded, m)
        out |= {"message_events": ev, "exposure": J.exposure_scope(m, reads, anchors.attacker_ips), "deleted": deleted, "completeness": Q.completeness(deleted)}
        f = f.join(ev.select("path", "confirmed", F.col("read_only").alias("attacker_read")), "path", "left")
    else:
        f = f.withColumns({"confirmed": F.lit(False), "attacker_read": F.lit(False)})
    no = F.lit(False)
    if signins is not None:
        found = N.analyze(signins, anchors.attacker_ips, victims)
        out |= {f"signin_{k}": v for k, v in found.items()}
        f = _flagged(f, N.confirmed_lures(m, found["tokens"], lure_window_sec), "signin_confirmed")
    else:
        f = f.withColumn("signin_confirmed", no)
    named = S.any_of(text.normalize_subject(F.col("subject")), tuple(s.strip().lower() for s in anchors.subjects if s.strip())) if anchors.subjects else no
    sent = named & A.one_of("sender_domain", victims) & S.after_compromise(F.col("sec"), anchors)
    f = materialize(f.withColumns({"confirmed": F.coalesce("confirmed", no), "attacker_read": F.coalesce("attacker_read", no), "anchored": F.col("anchors") > 0, "in_window": S.in_lookback(F.col("sec"), anchors), "relevant": S.relevant(F.col("sec"), anchors), "attacker_sent": sent}))
    tiers = materialize(P.tiers(f, t))
    tiered = materialize(f.join(tiers, "path"))
    out |= {"tiers": tiers, "verdict": _verdict(f, takeover, t), "shortlist": P.shortlist(f), "statistics": P.signal_statistics(base, tiers), "techniques": P.technique_summary(base)}

    feats = materialize(tiered.select("path", "sender", F.col("sender_domain").alias("domain"), "day", text.normalize_subject(F.col("subject")).alias("subject"), text.token_set(F.col("subject")).alias("subject_tokens"), text.terms_present(body, tuple(C.PHISHING_TERMS)).alias("terms"), F.array_distinct(F.transform("urls", lambda u: url.parts(u)["host"])).alias("urls"), F.transform("attachments", lambda a: files.attachment_key(a["filename"])).alias("files"), F.transform("attachments", lambda a: a["sha256"]).alias("hashes"), "recipients"))
    keys = {"subject": (F.array("subject"), False), "sender": (F.array("sender"), False), "domain": (F.array("domain"), True), "url": (F.col("urls"), False), "file": (F.col("files"), False), "term": (F.col("terms"), True)}
    members = K.campaign_members(feats, keys, t)
    out["campaigns"] = K.campaign_summary(members.join(tiered.select("path", "sender", F.col("sender_domain").alias("domain"), "day", "score", F.col("likely_precursor").alias("precursor"), F.transform("urls", lambda u: url.parts(u)["host"]).alias("urls")), "path"))
    out["campaign_indicators"] = K.campaign_indicators(members.join(tiered.select("path", "sender", F.col("sender_domain").alias("domain"), "score", F.col("likely_precursor").alias("precursor"), F.transform("urls", lambda u: url.parts(u)["host"]).alias("urls"), F.transform("attachments", lambda a: a["filename"]).alias("files")), "path"))

    about, none = ["path", "day", "tier", "score"], F.lit("").alias("context")
    kinds = [tiered.select(F.lit(k).alias("type"), F.col(c).alias("value"), none, *about) for k, c in (("sender_domain", "sender_domain"), ("sender_email", "sender"), ("origin_ip", "origin_ip"))]
    kinds += [tiered.select(F.lit("url").alias("type"), F.explode("urls").alias("value"), none, *about), tiered.select(F.lit("url_domain").alias("type"), F.explode(F.array_distinct(F.transform("urls", url.registrable))).alias("value"), none, *about)]
    kinds.append(tiered.select(F.lit("attachment_sha256").alias("type"), F.explode("attachments").alias("a"), *about).select("type", F.col("a.sha256").alias("value"), F.col("a.filename").alias("context"), *about))
    out["iocs"] = R.ioc_rollup(R.union_all(kinds))
    lines = [tiered.filter("tier <= 2").select("sec", F.lit("message").alias("source"), F.col("subject").alias("what"), F.col("path").alias("ref"))]
    if audit is not None:
        lines.append(audit.filter(A.one_of("ip", anchors.attacker_ips)).select("sec", F.lit("audit").alias("source"), F.col("op").alias("what"), F.col("ip").alias("ref")))
        out |= {"sessions": A.session_rollup(audit, anchors.attacker_ips, anchors.compromise_sec or 0), "ip_activity": A.ip_activity(audit, anchors.attacker_ips)}
        cover = A.coverage(audit)
        out |= {"coverage": cover, "file_activity": A.file_activity(audit, anchors.attacker_ips), "coverage_warnings": _limits(cover, tiered, anchors)}
    if evidence:
        out |= V.analyze(evidence, tiered, anchors, victim_domains, audit, containment_sec)
    if persistence is not None:
        out |= {"persistence": persistence, "remediation": I.remediation_plan(persistence)}
    if "persistence" in out:
        lines.append(I.timeline_rows(out["persistence"]))
    out["timeline"] = R.timeline(lines)
    out["narrative"] = V.story(out, tiered, audit, anchors)
    out["case_page"] = S.case_page(V.answers(out, anchors))
    out["messages"] = tiered
    return Case(anchors, out)


def _limits(cover: DataFrame, messages: DataFrame, anchors: S.Anchors) -> DataFrame:
    """audit.coverage_warnings() of a case: none without dated messages or without a compromise."""
    span = messages.agg(F.min("sec").alias("lo"), F.max("sec").alias("hi")).first()
    if span.lo is None or anchors.compromise_sec is None:
        return cover.sparkSession.createDataFrame([], "severity string, text string")
    return A.coverage_warnings(cover, span.lo, span.hi, anchors.compromise_sec, anchors.lookback_days)


def _flagged(f: DataFrame, hits: DataFrame, flag: str) -> DataFrame:
    """f with a boolean column: whether a message's path is among the hits'."""
    return f.join(hits.select(F.col("path").alias("__hit")).distinct(), F.col("path") == F.col("__hit"), "left").withColumn(flag, F.col("__hit").isNotNull()).drop("__hit")


def _lookalikes(domains: DataFrame, victims: tuple[str, ...], m: DataFrame, t: C.Thresholds) -> DataFrame:
    """sender_domain, lookalike: domains that look like a frequent or internal one, or the victim's own; all of them are
    compared, by keys."""
    inside = B.internal_domains(m.select("sender_domain", F.explode_outer("recipients").alias("r")).withColumn("recipient_domain", domain_of(F.col("r"))), "recipient_domain", t)
    own = m.sparkSession.createDataFrame([(v,) for v in victims], "name string")
    known = domains.filter("frequent").select(F.col("sender_domain").alias("name")).union(inside.select("domain")).union(own).distinct()
    rest = domains.select(F.col("sender_domain").alias("name")).join(known, "name", "left_anti")
    return B.lookalikes(rest, known).select(F.col("name").alias("sender_domain")).distinct().withColumn("lookalike", F.lit(True))


def _verdict(f: DataFrame, takeover: bool, t: C.Thresholds) -> DataFrame:
    """P.initial_verdict() for textual paths."""
    pool = f.filter("scenario_score > 0" + (" AND in_window" if takeover else ""))
    strong, time = F.col("scenario_score") >= t.tier1, F.coalesce("sec", F.lit(1 << 40))
    order = [F.desc(strong), F.when(strong, time).otherwise(-F.col("scenario_score"))] if takeover else [F.desc("scenario_score"), time]
    keep = pool.select("path", "sec", "scenario_score", "anchored").orderBy(*order, F.desc("scenario_score"), "path").limit(1)
    sure = F.when(F.col("anchored") & (F.col("scenario_score") >= 16), "high").when(F.col("scenario_score") >= t.tier1, "medium").otherwise("low")
    return keep.withColumn("confidence", sure)
