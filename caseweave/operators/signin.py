"""Operators over sign-ins: event_id, sec, user, ip, code, ok, asn, country, agent, corr, interactive, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave import config as C
from caseweave.operators.audit import one_of

# What marks a device-code sign-in, a legacy protocol and an automated client.
DEVICE_CODE = ("devicecodeflow", "devicecode")
LEGACY_APPS = ("imap", "pop", "smtp", "exchange activesync", "authenticated smtp", "mapi", "other clients")
AUTOMATION_AGENTS = ("python-requests", "curl", "go-http-client", "axios", "okhttp", "powershell", "libwww", "wget", "httpie", "restsharp", "java/", "node-fetch")


def filled(col: str) -> Column:
    return F.nullif(F.trim(F.col(col)), F.lit(""))


def short_agent(agent: Column, width: int = 60) -> Column:
    """What a user agent says of its client: from the first of the known names that it holds (as tried in order), else
    from its start, `width` characters; `?` for none."""
    ua = F.coalesce(F.nullif(agent, F.lit("")), F.lit("?"))
    low, out = F.lower(ua), None
    for t in C.AGENT_TOKENS:
        at = F.instr(low, t.lower())
        cut = F.substring(ua, at, F.lit(width))
        out = F.when(at > 0, cut) if out is None else out.when(at > 0, cut)
    return out.otherwise(F.substring(ua, 1, width))


def is_device_code(transfer: Column, protocol: Column) -> Column:
    def low(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    return low(transfer).isin(*DEVICE_CODE) | low(protocol).isin(*DEVICE_CODE)


def device_code_groups(legs: DataFrame) -> DataFrame:
    """Verdict for each correlation: attack if its legs come from several addresses, countries or networks, else single
    or consistent. A differing agent is named but proves nothing."""
    g = legs.groupBy("corr").agg(
        F.min_by("user", F.struct("sec", "event_id")).alias("user"), F.count("*").alias("legs"),
        *[F.count_distinct(filled(c)).alias(f"n_{c}") for c in ("ip", "country", "asn")], F.count_distinct(F.nullif(short_agent(filled("agent")), F.lit("?"))).alias("n_agent"),
        F.count_if("interactive").alias("interactive_legs"),
    )
    differs = F.filter(F.array(*[F.when(F.col(f"n_{c}") > 1, F.lit(t)) for c, t in (("ip", "IP"), ("country", "country"), ("asn", "ASN"), ("agent", "user agent"))]), lambda x: x.isNotNull())
    located = (F.col("n_ip") > 1) | (F.col("n_country") > 1) | (F.col("n_asn") > 1)
    split = (F.col("interactive_legs") > 0) & (F.col("interactive_legs") < F.col("legs"))
    verdict = F.when(located, "attack").when(F.col("legs") == 1, "single").otherwise("consistent")
    return g.select("corr", "user", "legs", F.array_join(differs, ",").alias("differs"), verdict.alias("verdict"), split.alias("attributable"))


def location(city: Column, country: Column) -> Column:
    """city, country as far as they are known; `?` for neither."""
    return F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit(""))), F.lit("")), F.lit("?"))


def leg_rows(legs: DataFrame) -> DataFrame:
    """Legs as reports show them: corr, time, interactive, ip, location, asn, client, app, requirement, token_type, ok."""
    have = set(legs.columns)
    city = F.col("city") if "city" in have else F.lit("")
    when = F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd HH:mm:ss")
    return legs.select("corr", when.alias("time"), "interactive", F.coalesce(F.nullif("ip", F.lit("")), F.lit("?")).alias("ip"), location(city, F.col("country")).alias("location"), "asn", short_agent(F.col("agent")).alias("client"), F.coalesce(F.nullif("app", F.lit("")), F.lit("?")).alias("app"), "requirement", "token_type", "ok")


def resolve_single_groups(groups: DataFrame, legs: DataFrame, attacker_ips: tuple[str, ...]) -> DataFrame:
    """device_code_groups() with matched_ips: correlations of one leg, and of it only, are an attack if the audit log
    knows one of their addresses as the attacker's."""
    hit = legs.filter(one_of("ip", attacker_ips)).groupBy(F.col("corr").alias("of")).agg(F.array_sort(F.collect_set("ip")).alias("matched"))
    g = groups.join(hit, F.col("corr") == F.col("of"), "left")
    found = (F.col("verdict") == "single") & F.col("matched").isNotNull()
    return g.withColumns({"verdict": F.when(found, "attack").otherwise(F.col("verdict")), "matched_ips": F.when(found, F.col("matched")).otherwise(F.array().cast("array<string>"))}).drop("of", "matched")


def user_profiles(signins: DataFrame) -> DataFrame:
    """How often each user's successful sign-ins came from each network, country and client (short_agent): user, kind,
    value, seen, n (all of the user's successes)."""
    values = {"asn": F.col("asn"), "country": F.col("country"), "agent": short_agent(F.col("agent"), 30)}
    ok = signins.filter("ok AND user <> ''").select(F.lower("user").alias("user"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])).alias("x"))
    seen = ok.groupBy("user", "x.kind", "x.value").agg(F.count("*").alias("seen"))
    total = F.sum("seen").over(Window.partitionBy("user", "kind"))
    return seen.withColumn("n", total).filter("value NOT IN ('', '?')")


def rare(seen: Column, n: Column, share: float = 0.05, floor: int = 2, history: int = 5) -> Column:
    """Rare against the user's own history, which has to exist: n of `history` or more, seen in few of them."""
    n, seen = F.coalesce(n, F.lit(0)), F.coalesce(seen, F.lit(0))
    return (n >= history) & (seen <= F.greatest(F.lit(float(floor)), n * share))


def aitm_scores(signins: DataFrame, floor: int = 6) -> DataFrame:
    """Score of each successful sign-in as an adversary in the middle: a token or claim instead of authentication, from
    places and clients that are rare for the user. Sign-ins by device code have rules of their own and are left out.
    signins may have token_claim, single_factor (booleans), risk, transfer and protocol.

    A user's profile is one row with a map for each kind, so every sign-in meets it in one join."""
    prof = user_profiles(signins).groupBy("user").agg(F.max("n").alias("n"), *[F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("value", "seen")))).alias(f"p_{k}") for k in ("asn", "country", "agent")])
    prof = prof.withColumnRenamed("user", "of")
    have = set(signins.columns)
    flow = is_device_code(F.col("transfer") if "transfer" in have else F.lit(""), F.col("protocol") if "protocol" in have else F.lit(""))
    out = signins.filter(F.col("ok") & ~flow).withColumns({"key": F.lower("user"), "agent": short_agent(F.col("agent"), 30)}).join(prof, F.col("key") == F.col("of"), "left")
    seldom = {k: (F.col(k) != "") & (F.col(k) != "?") & rare(F.try_element_at(F.col(f"p_{k}"), F.col(k)), F.col("n")) for k in ("asn", "country", "agent")}
    parts = [F.when(F.col("token_claim"), 3), F.when(F.col("single_factor"), 2), F.when(seldom["asn"], 3), F.when(seldom["country"], 2), F.when(seldom["agent"], 1), F.when(F.lower(F.trim("risk")).isin("medium", "high"), 2)]
    score = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return out.select("event_id", "user", "ip", score.alias("score")).withColumn("indicated", F.col("score") >= floor)


def mfa_fatigue(signins: DataFrame, window_sec: int = 3600, least: int = 5) -> DataFrame:
    """Users and addresses with a dense run of prompts (codes of the second factor) that a success follows."""
    s = signins.filter("user <> '' AND ip <> '' AND sec IS NOT NULL").withColumn("user", F.lower("user"))
    gate = F.when(one_of("code", C.MFA_GATE_CODES), F.col("sec"))
    runs = s.groupBy("user", "ip").agg(F.count(gate).alias("prompts"), F.min(gate).alias("first_sec"), F.max(gate).alias("last_sec"))
    runs = runs.filter((F.col("prompts") >= least) & (F.col("last_sec") - F.col("first_sec") <= 4 * window_sec))
    ok = s.filter("ok").select(F.col("user").alias("u"), F.col("ip").alias("i"), F.col("sec").alias("at"))
    hit = runs.join(ok, (F.col("user") == F.col("u")) & (F.col("ip") == F.col("i")) & F.col("at").between(F.col("last_sec"), F.col("last_sec") + window_sec))
    return hit.groupBy("user", "ip", "prompts", "first_sec", "last_sec").agg(F.min("at").alias("approved_sec"))


def password_spray(signins: DataFrame, window_sec: int = 3600, least_users: int = 5, key: str = "ip") -> DataFrame:
    """Addresses from which wrong passwords hit many users within a trailing window: the most at once, and all failures.

    Each failure says that its user counts from then to the window's end, or to the user's next failure: the intervals
    of one user don't overlap, so the users at a time are a running sum of +1 and -1. Those are summed up by second
    before they are put in order, and in order of time within spans of the window's length, so neither a hot address
    nor a hot user brings more rows to a task than there are seconds in a window."""
    bad = signins.filter(one_of("code", C.BAD_PASSWORD_CODES) & (F.col(key) != "") & (F.col("user") != ""))
    hits = bad.groupBy(key, F.lower("user").alias("user"), "sec").agg(F.count("*").alias("failures"))
    total = hits.groupBy(key).agg(F.sum("failures").alias("failures"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    nxt = F.lead("sec").over(Window.partitionBy(key, "user").orderBy("sec"))
    hits = hits.filter("sec IS NOT NULL").withColumn("to", F.least(F.col("sec") + window_sec + 1, F.coalesce(nxt, F.lit(1 << 60))))
    steps = hits.select(key, F.explode(F.array(F.struct(F.col("sec").alias("at"), F.lit(1).alias("d")), F.struct(F.col("to").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(key, "x.at").agg(F.sum("x.d").alias("d")).withColumn("span", F.floor(F.col("at") / window_sec))
    spans = steps.groupBy(key, "span").agg(F.sum("d").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col(key).alias("__k"), F.col("span").alias("__s"), before.alias("before"))
    run = F.sum("d").over(Window.partitionBy(key, "span").orderBy("at"))
    at_once = steps.withColumn("run", run).join(spans, (F.col(key) == F.col("__k")) & (F.col("span") == F.col("__s")))
    most = at_once.groupBy(key).agg(F.max(F.col("before") + F.col("run")).alias("users_hit"))
    return total.join(most.filter(F.col("users_hit") >= least_users), key).select(key, "users_hit", "failures", "first_sec", "last_sec")


def legacy_auth(signins: DataFrame, affected: tuple[str, ...], attacker_ips: tuple[str, ...], client_app: str = "client_app") -> DataFrame:
    """Sign-ins over protocols that never ask for a second factor, by protocol: attempts, successes, and successes that matter."""
    app = F.lower(F.trim(F.coalesce(F.col(client_app), F.lit(""))))
    legacy = F.lit(False)
    for a in LEGACY_APPS:
        legacy |= app.contains(a)
    hit = F.col("ok") & (F.lower("user").isin(*[a.lower() for a in affected]) | one_of("ip", attacker_ips))
    return signins.filter(legacy).groupBy(app.alias("protocol")).agg(F.count("*").alias("total"), F.count_if("ok").alias("successes"), F.count_if(hit).alias("indicated"))


def single_leg_scores(legs: DataFrame, floor: int = 6) -> DataFrame:
    """Device-code records that stand alone in their correlation, scored on their own: corr, app, score, indicated.

    legs: corr, app, expected (a client for which device code is routine), single_factor, token_claim, agent, no_access_policy, ok."""
    by_app = legs.filter("app <> ''").groupBy("app").agg(F.count("*").alias("seen"))
    total = by_app.agg(F.sum("seen").alias("total"))
    one = F.first(F.struct(*[c for c in legs.columns if c != "corr"])).alias("x")
    alone = legs.groupBy("corr").agg(F.count("*").alias("legs"), one).filter("legs = 1").select("corr", "x.*")
    s = alone.join(by_app, "app", "left").crossJoin(F.broadcast(total))
    rare_app = ~F.col("expected") & (F.col("seen") <= F.greatest(F.lit(2.0), F.col("total") * 0.01))
    automated = F.lit(False)
    for a in AUTOMATION_AGENTS:
        automated |= F.lower("agent").contains(a)
    parts = [(rare_app, 3), (F.col("single_factor"), 3), (F.col("token_claim"), 3), (automated, 2), (F.col("no_access_policy"), 2), (F.col("ok"), 1)]
    score = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for c, w in parts), F.lit(0))
    score = F.when(F.col("expected"), F.least(score, F.lit(floor - 1))).otherwise(score)
    return s.select("corr", "app", score.alias("score")).withColumn("indicated", F.col("score") >= floor)


def page_cap(file_counts: DataFrame, caps: tuple[int, ...] = C.PAGE_CAPS, share: float = 0.8) -> DataFrame:
    """One row: whether an export looks cut at a page size (the cap that most files have). file_counts: file, n (by name).

    Suspected are two files or more that all have the cap; or `share` of them, none larger, unless the only other one is
    the last: an export by pages ends on a short one. One file alone proves nothing. Without files: no row."""
    by_size = file_counts.filter("n > 0").groupBy("n").agg(F.count("*").alias("files"), F.max("file").alias("last"), F.min("file").alias("first"))
    row = F.struct("files", (-F.col("n")).alias("n"))
    r = by_size.agg(
        F.sum("files").alias("files"), F.sum(F.col("n") * F.col("files")).alias("records"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.max("last").alias("last"),
        F.max(F.when(F.col("n").isin(*caps), row)).alias("cap"), F.collect_list(F.when(F.col("files") == 1, F.struct("n", "last"))).alias("single"),
    ).filter("files > 0")
    r = r.withColumns({"page_cap": F.coalesce(-F.col("cap.n"), F.lit(0)), "files_at_cap": F.coalesce("cap.files", F.lit(0))})
    every = (F.col("page_cap") > 0) & (F.col("files_at_cap") == F.col("files"))
    nearly = (F.col("page_cap") > 0) & (F.col("files_at_cap") >= F.greatest(F.lit(2.0), share * F.col("files"))) & (F.col("largest") == F.col("page_cap"))
    last_short = (F.col("files") - F.col("files_at_cap") == 1) & F.exists("single", lambda x: (x["n"] != F.col("page_cap")) & (x["last"] == F.col("last")))
    return r.select("files", "records", "smallest", "largest", "page_cap", "files_at_cap", every.alias("all_at_cap"), ((every & (F.col("files") >= 2)) | (~every & nearly & ~last_short)).alias("suspected"))


def token_replay(audit: DataFrame, signins: DataFrame, token_ops: tuple[str, ...], least: int = 3) -> DataFrame:
    """Addresses that used tokens while the sign-in log was kept, and never signed in: ip, events, first_sec, last_sec."""
    span = F.broadcast(signins.agg(F.min("sec").alias("lo"), F.max("sec").alias("hi")))
    used = audit.filter("ip <> ''").crossJoin(span).filter(F.col("sec").between(F.col("lo"), F.col("hi")))
    active = used.groupBy("ip").agg(F.count("*").alias("events"), F.count_if(one_of("op_lower", token_ops)).alias("token_events"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    known = signins.filter("ok").select("ip").distinct()
    return active.filter((F.col("events") >= least) & (F.col("token_events") > 0)).join(known, "ip", "left_anti")
