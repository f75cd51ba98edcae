"""The directory and what outlives remediation: consents, credentials, rules, roles, devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.functions.text import name_key
from caseweave.operators.audit import one_of

# Directory activities in the order in which they are tried: text, kind, whether the access survives a
# password reset, and a revocation of tokens.
ACTIVITIES = (
    ("set domain authentication", "federation", "tenant", "tenant"), ("set federation settings on domain", "federation", "tenant", "tenant"), ("add unverified domain", "domain", "tenant", "tenant"), ("verify domain", "domain", "tenant", "tenant"),
    ("add verified domain", "domain", "tenant", "tenant"), ("partner cross-tenant access setting", "cross_tenant", "tenant", "tenant"), ("cross-tenant access setting", "cross_tenant", "tenant", "tenant"), ("crosstenantaccess", "cross_tenant", "tenant", "tenant"),
    ("invite external user", "external_identity", "survives", "survives"), ("redeem external user invite", "external_identity", "survives", "survives"), ("consent to application", "oauth_consent", "survives", "survives"), ("add delegated permission grant", "oauth_consent", "survives", "survives"),
    ("add app role assignment grant to user", "oauth_consent", "survives", "survives"), ("add app role assignment to service principal", "oauth_consent", "survives", "survives"), ("add service principal credentials", "sp_credential", "survives", "survives"), ("add service principal", "service_principal", "survives", "survives"),
    ("certificates and secrets management", "sp_credential", "survives", "survives"), ("user registered security info", "mfa_method", "conditional", "survives"), ("admin registered security info", "mfa_method", "conditional", "survives"), ("user changed default security info", "mfa_method", "conditional", "survives"),
    ("user deleted security info", "mfa_removed", "no", "no"), ("add member to role", "role_assignment", "survives", "survives"), ("add eligible member to role", "role_assignment", "survives", "survives"), ("add member to group", "group_membership", "survives", "survives"),
    ("add device", "device", "no", "partial"), ("add registered owner to device", "device", "no", "partial"), ("update conditional access policy", "ca_policy", "survives", "survives"), ("delete conditional access policy", "ca_policy", "survives", "survives"),
    ("add conditional access policy", "ca_policy", "survives", "survives"), ("disable strong authentication", "mfa_weakened", "survives", "survives"), ("set company information", "tenant_config", "survives", "survives"),
)
# Permission scopes by what they open.
MAIL_SCOPES = (
    "mail.read", "mail.readbasic", "mail.readwrite", "mail.send", "mail.read.shared", "mail.readwrite.shared", "mail.send.shared", "mailboxsettings.read", "mailboxsettings.readwrite",
    "imap.accessasuser.all", "pop.accessasuser.all", "smtp.send", "ews.accessasuser.all", "full_access_as_app",
)
HIGH_SCOPES = (
    "files.read.all", "files.readwrite.all", "sites.read.all", "sites.readwrite.all", "sites.fullcontrol.all", "directory.read.all", "directory.readwrite.all", "directory.accessasuser.all", "user.read.all", "user.readwrite.all", "group.readwrite.all",
    "application.readwrite.all", "approleassignment.readwrite.all", "roleassignmentschedule.readwrite.directory", "privilegedaccess.readwrite.azuread", "chat.read", "chat.readwrite", "chatmessage.read",
)
DURABLE_SCOPES = ("offline_access",)
# Folders that hide mail, and folders that people file into.
HIDDEN = ("rss feeds", "rss subscriptions", "conversation history", "notes", "sync issues")
FILED = ("archive", "junk", "deleted items", "trash", "clutter")
#: How long access lasts, longest first.
SURVIVAL = ("tenant", "survives", "partial", "conditional", "no")


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty nor the word null."""
    return F.coalesce(*[F.when(~F.lower(F.trim(c)).isin("", "null"), F.trim(c)) for c in cols])


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def scopes(permission: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(permission, F.lit(""))), r"[\s,;]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[\"']+|[\"']+$", "")), lambda p: p != ""))


def classify_scopes(permission: Column) -> Column:
    """A struct mail, high, durable (sorted scopes of each kind) and readable: whether the text holds scopes at all."""
    s = scopes(permission)

    def of(kind: tuple[str, ...]) -> Column:
        return F.array_sort(F.array_intersect(s, F.array(*[F.lit(x) for x in kind])))

    readable = F.exists(s, lambda x: x.rlike(r"^[a-z][a-z0-9]*\.[a-z]") | x.isin(*DURABLE_SCOPES))
    return F.struct(of(MAIL_SCOPES).alias("mail"), of(HIGH_SCOPES).alias("high"), of(DURABLE_SCOPES).alias("durable"), readable.alias("readable"))


def match_activity(name: Column) -> Column:
    """A struct kind, password, token of the first activity whose text the name contains, or null."""
    low, out = F.lower(F.trim(F.coalesce(name, F.lit("")))), None
    for needle, kind, pw, tok in ACTIVITIES:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(pw).alias("password"), F.lit(tok).alias("token"))
        out = F.when(low.contains(needle), value) if out is None else out.when(low.contains(needle), value)
    return out


def directory_audit(rows: DataFrame) -> DataFrame:
    """Directory events that leave access behind: id, kind, activity, sec, actor, ip, target, scopes, password, token.
    rows: id, activity, result, sec, actor, ip, target, permission. Failures are left out."""
    r = rows.withColumn("m", match_activity(F.col("activity"))).filter("m IS NOT NULL AND lower(coalesce(result, 'success')) NOT IN ('failure', 'failed')")
    return r.select("id", F.lit("entra_audit").alias("source"), "m.kind", "activity", "sec", "actor", "ip", "target", classify_scopes(F.col("permission")).alias("scopes"), "m.password", "m.token")


def oauth_grants(rows: DataFrame) -> DataFrame:
    """Grants that open mail or more, in the shape of directory_audit(). rows: id, app, permission, principal, sec."""
    r = rows.withColumn("scopes", classify_scopes(F.col("permission"))).filter((F.size("scopes.mail") > 0) | (F.size("scopes.high") > 0))
    keep = F.lit("survives")
    return r.select("id", F.lit("oauth_permissions").alias("source"), F.lit("oauth_consent").alias("kind"), F.lit("Existing OAuth grant").alias("activity"), "sec", F.col("principal").alias("actor"), F.lit("").alias("ip"), F.col("app").alias("target"), "scopes", keep.alias("password"), keep.alias("token"))


def persistence(events: DataFrame, attacker_ips: tuple[str, ...], start_sec: int | None, end_sec: int | None, victims: tuple[str, ...]) -> DataFrame:
    """Events with by_attacker and severity. The attacker's are those from his address, those of a victim in the window, and grants
    of an application that he consented to. A consent that is readable, harmless and not his is left out."""
    actor = F.lower(F.coalesce("actor", F.lit("")))
    victim = F.lit(False)
    for v in victims:
        victim |= actor.contains(v.lower())
    inside = F.lit(False) if start_sec is None else (F.col("sec") >= start_sec) & (F.lit(True) if end_sec is None else F.col("sec") <= end_sec)
    e = events.withColumn("direct", F.coalesce(one_of("ip", attacker_ips) | (inside & victim), F.lit(False))).withColumn("app", F.lower(F.trim("target")))
    his = e.filter("direct AND kind = 'oauth_consent'").select("app").distinct().withColumn("his", F.lit(True))
    e = e.join(his, "app", "left").withColumn("by_attacker", F.col("direct") | (F.coalesce("his", F.lit(False)) & (F.col("source") == "oauth_permissions")))
    harmless = (F.col("kind") == "oauth_consent") & ~F.col("by_attacker") & (F.size("scopes.mail") == 0) & (F.size("scopes.high") == 0) & F.col("scopes.readable")
    sev = F.when((F.col("password") == "tenant"), "high").when((F.col("password") == "survives") & (F.col("token") == "survives"), "high").when(F.col("password").isin("survives", "conditional") | F.col("token").isin("survives", "conditional"), "medium").otherwise("low")
    return e.filter(~harmless).withColumn("severity", sev).drop("direct", "app", "his")


def remediation_plan(actions: DataFrame) -> DataFrame:
    """rank, kind, target, by_attacker, sources: one action for each kind and target, the attacker's first, then by how long the
    access lasts. actions: kind, target, by_attacker, password, sec, source."""
    order = F.array_position(F.array(*[F.lit(s) for s in SURVIVAL]), F.col("password"))
    g = actions.withColumn("order", F.when(order > 0, order).otherwise(99)).groupBy("kind", F.lower(F.trim("target")).alias("key")).agg(
        F.min_by("target", F.struct(~F.col("by_attacker"), F.coalesce("sec", F.lit(1 << 40)), "target")).alias("target"), F.bool_or("by_attacker").alias("by_attacker"), F.min("order").alias("order"), F.min("sec").alias("sec"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )
    rank = F.row_number().over(Window.orderBy(F.desc("by_attacker"), "order", F.asc_nulls_last("sec"), "kind", "key"))  # a row for each action of a case
    return g.select(rank.alias("rank"), "kind", "target", "by_attacker", "sources")


def directory_users(rows: DataFrame) -> DataFrame:
    """address, name_key, display_name, title of each user and each proxy address. rows: user_principal_name, display_name, title, proxy_addresses (`;`)."""
    proxies = F.transform(F.split(F.coalesce("proxy_addresses", F.lit("")), ";"), lambda p: F.lower(F.trim(F.regexp_replace(p, "(?i)^smtp:", ""))))
    all_ = F.array_distinct(F.filter(F.concat(F.array(F.lower(F.trim("user_principal_name"))), proxies), lambda a: a.contains("@")))
    return rows.select(F.explode(all_).alias("address"), name_key(F.col("display_name")).alias("name_key"), "display_name", "title")


def impersonation(messages: DataFrame, users: DataFrame) -> DataFrame:
    """path, person: messages whose sender has the name of a person in the directory, and none of that person's addresses.
    messages: path, sender_name, sender."""
    m = messages.select("path", name_key(F.col("sender_name")).alias("key"), F.lower("sender").alias("sender")).filter("key LIKE '% %'")
    people = users.groupBy("name_key").agg(F.collect_set("address").alias("addresses"), F.min("display_name").alias("person"))
    return m.join(people, m["key"] == people["name_key"]).filter(~F.array_contains("addresses", F.col("sender"))).select("path", "person")


def mailbox_rules(rows: DataFrame) -> DataFrame:
    """name, mailbox, forwards, words, move_to, conceals of live rules. rows: name, mailbox, forward_to, move_to, delete, words.
    Filing into a folder that people use conceals only by words."""
    folder = F.lower(F.trim(F.coalesce("move_to", F.lit(""))))
    words = F.filter(F.transform(F.split(F.lower(F.coalesce("words", F.lit(""))), "[;,]"), lambda w: F.regexp_replace(F.trim(w), "^[\"']+|[\"']+$", "")), lambda w: w != "")
    forwards = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("forward_to", F.lit("")), F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"), F.lit(1)), F.lower))
    r = rows.select("name", "mailbox", forwards.alias("forwards"), words.alias("words"), folder.alias("move_to"), truthy(F.col("delete")).alias("gone"))
    hides = F.col("gone") | (F.size("forwards") > 0) | F.col("move_to").isin(*HIDDEN) | (F.col("move_to").isin(*FILED) & (F.size("words") > 0))
    return r.select("name", "mailbox", "forwards", "words", "move_to", hides.alias("conceals"))


def rule_findings(rules: DataFrame) -> DataFrame:
    """Which rules look malicious, and why. rules: name, forwards, words, move_to, conceals, mark_read, stop."""
    name = F.coalesce("name", F.lit(""))
    odd = (F.length(F.trim(name)) <= 2) & ~F.trim(name).rlike("[A-Za-z0-9]{2}")
    quiet = F.col("mark_read") | F.col("stop")
    suspicious = (F.size("forwards") > 0) | F.col("conceals") | (F.size("words") > 0) | odd | (quiet & (F.coalesce("move_to", F.lit("")) != ""))
    return rules.select("name", odd.alias("odd_name"), suspicious.alias("suspicious"))


def mailbox_permissions(rows: DataFrame) -> DataFrame:
    """Grants on mailboxes, without inherited ones and those of system principals. rows: mailbox, user, rights, inherited."""
    return rows.filter(~truthy(F.col("inherited")) & ~F.lower("user").rlike(r"^(nt authority\\|s-1-5-|.*\\(domain|enterprise|organization) )")).select("mailbox", F.lower("user").alias("user"), "rights")


def audit_status(rows: DataFrame, victim: str) -> DataFrame:
    """The audit settings of the victim's mailbox: the last row of it, or the only mailbox's if it isn't there. rows: seq, mailbox, enabled."""
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy(F.lower("mailbox")).orderBy(F.desc("seq")))).filter("r = 1")
    n = F.broadcast(last.agg(F.count("*").alias("n"), F.count_if(F.lower("mailbox") == victim.lower()).alias("own")))
    return last.crossJoin(n).filter((F.lower("mailbox") == victim.lower()) | ((F.col("own") == 0) & (F.col("n") == 1))).select("mailbox", truthy(F.col("enabled")).alias("enabled"), *[c for c in rows.columns if c == "records_reads"])


def owner_addresses(signins: DataFrame, devices: DataFrame) -> DataFrame:
    """ip: addresses of interactive sign-ins from a device that the user owns. signins: user, ip, interactive, device_id; devices: device_id, owner."""
    d = devices.select(F.col("device_id").alias("d"), F.lower("owner").alias("o"))
    return signins.filter("interactive AND ip <> '' AND device_id <> ''").join(d, (F.col("device_id") == F.col("d")) & (F.lower("user") == F.col("o")), "left_semi").select("ip").distinct()


def geo_lookup(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """rows with country: by ranges (lo, hi: longs, country) of up to a /16 each, joined by the first two octets, so no
    row meets all ranges."""
    from caseweave.functions.address import ipv4_number

    n = ipv4_number(F.col(ip))
    r = ranges.select(F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "country", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("block"))
    x = rows.withColumn("_n", n)
    return x.join(r, (F.shiftright("_n", 16) == F.col("block")) & F.col("_n").between(F.col("r_lo"), F.col("r_hi")), "left").drop("_n", "r_lo", "r_hi", "block")


def initiator(initiated_by: Column, actor: Column, ip: Column) -> Column:
    """A struct actor, ip of a directory-audit record: of flat columns, of the object initiatedBy as JSON (a user, else an
    application), or of its printed form."""
    def of(path: str) -> Column:
        return F.nullif(F.get_json_object(initiated_by, path), F.lit(""))

    printed = F.nullif(F.regexp_extract(initiated_by, r"userPrincipalName=([^;,}\s]+)", 1), F.lit(""))
    plain = F.when(~initiated_by.startswith("{") & ~initiated_by.startswith("@{"), F.nullif(initiated_by, F.lit("")))
    who = F.coalesce(F.nullif(actor, F.lit("")), of("$.user.userPrincipalName"), of("$.user.displayName"), of("$.app.displayName"), printed, plain, F.lit(""))
    return F.struct(who.alias("actor"), F.coalesce(F.nullif(ip, F.lit("")), of("$.user.ipAddress"), F.lit("")).alias("ip"))


TARGETS = "array<struct<displayName:string,id:string,modifiedProperties:array<struct<newValue:string,oldValue:string>>>>"


def targets(resources: Column) -> Column:
    """A struct names (array), permission (text) of targetResources: JSON, else a plain text that is both. Of modified
    properties only values are read: their names look like scopes and are none."""
    parsed = F.from_json(resources, TARGETS)
    names = F.filter(F.transform(parsed, lambda t: F.coalesce(F.nullif(t["displayName"], F.lit("")), F.nullif(t["id"], F.lit("")))), lambda n: n.isNotNull())
    values = F.flatten(F.transform(parsed, lambda t: F.transform(F.coalesce(t["modifiedProperties"], F.array().cast("array<struct<newValue:string,oldValue:string>>")), lambda p: F.concat_ws(" ", p["newValue"], p["oldValue"]))))
    text = F.trim(F.coalesce(resources, F.lit("")))
    is_json = text.startswith("[")
    plain = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(text, 1, 200)))
    return F.struct(F.when(is_json, names).otherwise(plain).alias("names"), F.when(is_json, F.array_join(values, " ")).otherwise(text).alias("permission"))


def timeline_rows(events: DataFrame) -> DataFrame:
    """persistence() as rows of the timeline: sec, source, what, ref. Events without a time are left out."""
    what = F.concat_ws(": ", "activity", F.nullif("target", F.lit("")))
    return events.filter("sec IS NOT NULL").select("sec", F.lit("persistence").alias("source"), what.alias("what"), F.coalesce("actor", F.lit("")).alias("ref"))


def drift_actions(rules: DataFrame, transport: DataFrame, granted: DataFrame) -> DataFrame:
    """What the configuration shows and no log explains, as actions for remediation_plan(): source, kind, target, by_attacker,
    sec, password, token, scope. rules: name, external; transport: name, redirects; granted: mailbox, user, external."""
    keep = [F.lit(False).alias("by_attacker"), F.lit(None).cast("long").alias("sec"), F.lit("survives").alias("password"), F.lit("survives").alias("token"), F.lit("inferred").alias("scope")]
    a = rules.select(F.lit("drift").alias("source"), F.lit("inbox_rule").alias("kind"), F.col("name").alias("target"), *keep)
    b = transport.filter(F.size("redirects") > 0).select(F.lit("drift").alias("source"), F.lit("transport_rule").alias("kind"), F.col("name").alias("target"), *keep)
    c = granted.filter("external").select(F.lit("drift").alias("source"), F.lit("delegation").alias("kind"), F.concat("user", F.lit(" -> "), "mailbox").alias("target"), *keep)
    return a.unionByName(b).unionByName(c)


def directory_stats(users: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: users, enabled ones, addresses, distinct names, accepted domains. users: user_principal_name, display_name,
    proxy_addresses, enabled (may be missing)."""
    enabled = truthy(F.col("enabled")) if "enabled" in users.columns else F.lit(False)
    mails = F.transform(F.split(F.lower(F.concat_ws(";", "user_principal_name", "proxy_addresses")), "[;,]"), lambda a: F.regexp_replace(F.trim(a), "^smtp:", ""))
    known = users.select(F.explode(F.filter(mails, lambda a: a.contains("@"))).alias("a")).agg(F.count_distinct("a").alias("addresses"))
    names = users.select(name_key(F.col("display_name")).alias("k")).filter("k <> ''").agg(F.count_distinct("k").alias("names"))
    one = users.agg(F.count("*").alias("users"), F.count_if(enabled).alias("enabled"))
    return one.crossJoin(known).crossJoin(names).crossJoin(domains.agg(F.count_distinct("domain").alias("accepted_domains")))
