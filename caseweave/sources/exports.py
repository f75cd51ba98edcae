"""Evidence exports: CSV, JSON arrays, wrapped JSON and JSON lines, told apart by their first character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.timeparse import parse_iso
from caseweave.operators.identity import initiator, mailbox_rules, targets

#: Columns under which exports wrap their records.
WRAPPERS = ("value", "records", "items", "signins", "data")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export with lower-case column names, and file_name. Delimiters , ; tab and | are told by the header line."""
    head = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    first = head[0].value.lstrip("﻿ \t") if head else ""
    if first[:1] in "[{" and first:
        one_line = first.startswith("{") and first.rstrip().endswith("}") and not any(f'"{w}"' in first[:40].lower() for w in WRAPPERS)
        df = spark.read.option("multiLine", not one_line).json(path)
        for name in df.columns:
            kind = df.schema[name].dataType
            if name.lower() in WRAPPERS and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                df = df.select(F.explode(name).alias("r"), F.col("_metadata.file_name").alias("file_name")).select("file_name", "r.*")
                break
        else:
            df = df.select("*", F.col("_metadata.file_name").alias("file_name"))
    else:
        sep = max(",;\t|", key=first.count)
        df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    return df.select(*[F.col(f"`{c}`").alias(c.lower().lstrip("﻿").strip()) for c in df.columns])


def field(df: DataFrame, *names: str) -> Column:
    """The first filled one of columns by alternative names (nested ones with dots), as text; null where none is there."""
    have = []
    for n in names:
        top, *rest = n.lower().split(".")
        if top in df.columns:
            kind, ok = df.schema[top].dataType, True
            col = F.col(f"`{top}`")
            for r in rest:
                match = next((f for f in kind.fields if f.name.lower() == r), None) if isinstance(kind, T.StructType) else None
                if match is None:
                    ok = False
                    break
                col, kind = col[match.name], match.dataType
            if ok and not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                text = F.trim(col.cast("string"))
                have.append(F.when(~F.lower(text).isin("", "null"), text))
    return F.coalesce(*have, F.lit(None).cast("string"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A unified audit log: sec, op, op_lower, actor, ip, session_id, client_info, logon_type, mailbox_owner, message_ids, parameters.
    Fields come from the row or from its AuditData, a JSON text."""
    df = read_export(spark, path)
    raw = field(df, "auditdata")

    def of(names: tuple[str, ...], *keys: str) -> Column:
        return F.coalesce(field(df, *names), *[F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")) for k in keys], F.lit(""))

    text = F.coalesce(raw, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    ids = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r'(?i)"internetmessageid"\s*:\s*"(<?[^"<>]+>?)"'), F.lit(1)), lambda x: F.lower(x)))
    subjects = F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?i)"subject"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)))
    pairs = F.regexp_extract_all(text, F.lit(r'(?i)"name"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*"([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'(?i)"name"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*"([^"]*)"'), F.lit(2))
    entries = F.arrays_zip(F.transform(pairs, F.lower).alias("k"), values.alias("v"))
    params = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    op = of(("operation", "operations"), "Operation")
    ip = F.regexp_extract(of(("clientip", "clientipaddress"), "ClientIP", "ClientIPAddress", "ActorIpAddress"), r"([0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:]+)", 1)
    return df.select(
        F.unix_seconds(parse_iso(of(("creationtime", "creationdate"), "CreationTime"))).alias("sec"), op.alias("op"), F.lower(op).alias("op_lower"), F.lower(of(("userid", "userids"), "UserId")).alias("actor"), ip.alias("ip"),
        of(("sessionid",), "SessionId", "AppAccessContext.AADSessionId").alias("session_id"), of(("clientinfostring",), "ClientInfoString").alias("client_info"), of(("logontype",), "LogonType").try_cast("int").alias("logon_type"),
        F.lower(of(("mailboxownerupn",), "MailboxOwnerUPN")).alias("mailbox_owner"), of(("objectid",), "ObjectId").alias("object_id"), ids.alias("message_ids"), subjects.alias("subjects"), params.alias("parameters"), "file_name",
    )


def read_signins(spark: SparkSession, path: str) -> DataFrame:
    """A sign-in log in any of its spellings: sec, user, ip, code, ok, asn, country, agent, corr, interactive, app, transfer, protocol, requirement, token_type, client_app, risk, device_id."""
    df = read_export(spark, path)
    code = F.coalesce(F.nullif(F.nullif(field(df, "status.errorcode", "errorcode", "resulttype"), F.lit("0")), F.lit("None")), F.lit(""))
    text = {
        "user": ("userprincipalname", "user", "username"), "ip": ("ipaddress", "ip address", "ip"), "asn": ("autonomoussystemnumber", "asn"), "country": ("location.countryorregion", "country", "location"), "agent": ("useragent", "user agent"),
        "corr": ("correlationid", "correlation id"), "app": ("appid", "applicationid", "appdisplayname", "application"), "transfer": ("originaltransfermethod",), "protocol": ("authenticationprotocol",), "requirement": ("authenticationrequirement",),
        "token_type": ("incomingtokentype",), "client_app": ("clientappused", "client app"), "risk": ("riskleveldaggregated", "risklevelduringsignin"), "device_id": ("devicedetail.deviceid", "deviceid"),
    }
    when = parse_iso(field(df, "createddatetime", "date (utc)", "date", "timegenerated"))
    cols = [F.coalesce(field(df, *names), F.lit("")).alias(c) for c, names in text.items()]
    inter = F.lower(F.coalesce(field(df, "isinteractive", "interactive"), F.lit(""))).isin("true", "1", "yes")
    return df.select(F.unix_seconds(when).alias("sec"), *cols, code.alias("code"), (code == "").alias("ok"), inter.alias("interactive"), "file_name")


#: Kinds of export, by what their file's name and their columns say.
KINDS = (
    ("signin", ("signin", "sign-in", "sign_in"), ("correlationid", "isinteractive")), ("audit", ("auditlog", "unified"), ("auditdata", "operation")), ("entra_audit", ("entraaudit", "directoryaudit"), ("activitydisplayname", "initiatedby")),
    ("oauth", ("oauth",), ("consenttype", "clientid")), ("rules", ("rules", "inboxrule"), ("forwardto", "movetofolder")), ("permissions", ("permission",), ("accessrights",)), ("trace", ("trace",), ("senderaddress", "recipientaddress")),
    ("users", ("users",), ("proxyaddresses",)), ("devices", ("devices",), ("deviceid", "trusttype")), ("mfa", ("mfa",), ("mfamethods",)), ("roles", ("role",), ("rolename",)), ("risk", ("risk",), ("riskeventtype",)), ("domains", ("domains",), ("domainname",)), ("audit_status", ("auditstatus",), ("auditenabled",)), ("transport", ("transport",), ("redirectmessageto",)),
)


def identify(name: str, columns: list[str]) -> str:
    """The kind of an export: two points for its name, one for each column; empty without any. Ties go to the first."""
    low, cols = name.lower().replace(" ", ""), {c.lower() for c in columns}
    points = [2 * any(n in low for n in names) + len(cols & set(heads)) for _, names, heads in KINDS]
    best = max(points)
    return KINDS[points.index(best)][0] if best else ""


def read_users(spark: SparkSession, path: str) -> DataFrame:
    df = read_export(spark, path)
    return df.select(field(df, "userprincipalname", "upn").alias("user_principal_name"), field(df, "displayname").alias("display_name"), field(df, "jobtitle", "title").alias("title"), field(df, "proxyaddresses", "emailaddresses").alias("proxy_addresses")).filter("user_principal_name IS NOT NULL")


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    df = read_export(spark, path)
    when = parse_iso(field(df, "registrationdatetime", "createddatetime", "approximatelastsignindatetime"))
    return df.select(field(df, "displayname", "devicename", "name").alias("name"), field(df, "deviceid", "id").alias("device_id"), F.lower(field(df, "userprincipalname", "registeredowners", "owner")).alias("owner"), F.unix_seconds(when).alias("sec")).filter("name IS NOT NULL")


def read_mfa(spark: SparkSession, path: str) -> DataFrame:
    df = read_export(spark, path)
    return df.select(field(df, "userprincipalname", "user", "upn", "displayname").alias("user"), field(df, "mfamethods", "authenticationmethods", "methods", "defaultmfamethod").alias("methods"), field(df, "mfaenabled", "mfastatus").alias("enabled")).filter("user IS NOT NULL")


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    df = read_export(spark, path)
    when = parse_iso(field(df, "assignmentdatetime", "createddatetime", "starttime", "activitydatetime"))
    return df.select(field(df, "rolename", "roledisplayname", "role").alias("role"), field(df, "userprincipalname", "principaldisplayname", "user", "member").alias("user"), F.unix_seconds(when).alias("sec")).filter("role IS NOT NULL")


def read_risk(spark: SparkSession, path: str) -> DataFrame:
    df = read_export(spark, path)
    when = parse_iso(field(df, "detecteddatetime", "activitydatetime", "createddatetime"))
    return df.select(field(df, "riskeventtype", "risktype", "detectiontype").alias("detection"), field(df, "userprincipalname", "user").alias("user"), field(df, "risklevel", "risklevelaggregated").alias("level"), field(df, "ipaddress", "ip").alias("ip"), F.unix_seconds(when).alias("sec")).filter("detection IS NOT NULL OR user IS NOT NULL")


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    df = read_export(spark, path)
    return df.select(F.lower(F.regexp_replace(field(df, "domainname", "domain", "name", "id"), "^@", "")).alias("domain")).filter("domain LIKE '%.%'").distinct()


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A message trace: message_id, sender, recipient, recipient_domain, subject, status, from_ip, sec."""
    df = read_export(spark, path)
    to = F.lower(F.coalesce(field(df, "recipientaddress", "recipient", "to"), F.lit("")))
    return df.select(
        F.coalesce(field(df, "messageid", "internetmessageid", "message_id"), F.lit("")).alias("message_id"), F.lower(F.coalesce(field(df, "senderaddress", "sender", "from"), F.lit(""))).alias("sender"), to.alias("recipient"), F.substring_index(to, "@", -1).alias("recipient_domain"),
        F.coalesce(field(df, "subject"), F.lit("")).alias("subject"), F.lower(F.regexp_replace(F.coalesce(field(df, "status", "deliverystatus"), F.lit("")), "[- ]", "")).alias("status"), F.coalesce(field(df, "fromip", "originalclientip", "clientip"), F.lit("")).alias("from_ip"), F.unix_seconds(parse_iso(field(df, "received", "date", "datetime", "timestamp"))).alias("sec"),
    ).filter("sender <> '' OR recipient <> ''")


def read_transport_rules(spark: SparkSession, path: str) -> DataFrame:
    df = read_export(spark, path)
    to = F.transform(F.split(F.lower(F.coalesce(field(df, "redirectmessageto", "blindcopyto", "copyto"), F.lit(""))), "[;,]"), F.trim)
    redirects = F.filter(to, lambda a: a.contains("@"))
    return df.select(field(df, "name", "identity", "rulename").alias("name"), field(df, "state", "enabled").alias("state"), redirects.alias("redirects"), (F.size(redirects) > 0).alias("conceals")).filter("name IS NOT NULL")


def _nested(df: DataFrame, name: str) -> Column:
    """A column as text: objects and lists as JSON; null where it isn't there."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.to_json(f"`{name}`") if isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{name}`").cast("string")


def read_entra_audit(spark: SparkSession, path: str) -> DataFrame:
    """A directory audit log: id, activity, result, sec, actor, ip, target, permission."""
    df = read_export(spark, path)
    who = initiator(_nested(df, "initiatedby"), field(df, "userprincipalname", "initiatedby_user_userprincipalname", "actor", "user"), field(df, "ipaddress", "initiatedby_user_ipaddress", "clientip", "ip"))
    on = targets(_nested(df, "targetresources"))
    plain = field(df, "targetdisplayname", "target", "objectid")
    when = parse_iso(field(df, "activitydatetime", "createddatetime", "timegenerated", "date", "time"))
    x = df.select(field(df, "id").alias("id"), field(df, "activitydisplayname", "activity", "operationname", "operation").alias("activity"), F.coalesce(field(df, "result", "resultstatus", "status"), F.lit("success")).alias("result"), F.unix_seconds(when).alias("sec"), who.alias("who"), on.alias("on"), plain.alias("plain"))
    return x.select("id", "activity", "result", "sec", "who.actor", "who.ip", F.coalesce(F.try_element_at("on.names", F.lit(1)), "plain", F.lit("")).alias("target"), F.coalesce(F.nullif("on.permission", F.lit("")), "plain", F.lit("")).alias("permission"))


def read_oauth(spark: SparkSession, path: str) -> DataFrame:
    """OAuth grants as they stand: id, app, permission, principal, sec."""
    df = read_export(spark, path)
    app, scopes = field(df, "applicationname", "clientdisplayname", "appdisplayname", "displayname", "application", "clientid"), field(df, "permission", "permissions", "scope", "scopes", "consentedpermissions", "approle", "value")
    x = df.select(field(df, "id", "grantid", "oauth2permissiongrantid").alias("id"), app.alias("app"), scopes.alias("permission"), F.coalesce(field(df, "principaldisplayname", "userprincipalname", "principal"), F.lit("")).alias("principal"), F.unix_seconds(parse_iso(field(df, "createddatetime", "consentdate", "grantdate"))).alias("sec"))
    return x.filter("app IS NOT NULL OR permission IS NOT NULL").withColumn("app", F.coalesce("app", F.lit("")))


def read_mailbox_rules(spark: SparkSession, path: str) -> DataFrame:
    """Inbox rules as they are now, by identity.mailbox_rules()."""
    df = read_export(spark, path)
    first = {"name": ("rulename", "name", "identity", "ruleidentity"), "mailbox": ("mailbox", "userprincipalname", "mailboxownerid", "primarysmtpaddress"), "forward_to": ("forwardto", "redirectto", "forwardasattachmentto"), "move_to": ("movetofolder", "copytofolder"), "delete": ("deletemessage", "softdeletemessage"), "words": ("subjectcontainswords", "bodycontainswords", "subjectorbodycontainswords")}
    return mailbox_rules(df.select(*[field(df, *names).alias(c) for c, names in first.items()]).filter("name IS NOT NULL OR mailbox IS NOT NULL").withColumn("name", F.coalesce("name", F.lit("(unnamed)"))))


def read_permissions(spark: SparkSession, path: str) -> DataFrame:
    """Grants on mailboxes: mailbox, user, rights, inherited."""
    df = read_export(spark, path)
    first = {"mailbox": ("identity", "mailbox", "primarysmtpaddress", "userprincipalname"), "user": ("user", "trustee", "granteename", "accessrightsholder"), "rights": ("accessrights", "rights", "permission"), "inherited": ("isinherited", "inherited")}
    return df.select(*[F.lower(field(df, *names)).alias(c) for c, names in first.items()]).filter("mailbox IS NOT NULL AND user IS NOT NULL").na.fill("", ["rights", "inherited"])


def read_audit_status(spark: SparkSession, path: str) -> DataFrame:
    """Audit settings of mailboxes: seq (the order of rows), mailbox, enabled, records_reads."""
    df = read_export(spark, path)
    combined = F.lower(F.concat_ws(" ", field(df, "auditowner"), field(df, "auditdelegate"), field(df, "auditadmin"), *[_nested(df, c) for c in ("auditowner", "auditdelegate", "auditadmin")]))
    return df.select(F.monotonically_increasing_id().alias("seq"), F.lower(field(df, "identity", "mailbox", "userprincipalname", "primarysmtpaddress")).alias("mailbox"), field(df, "auditenabled", "auditlogenabled", "defaultauditset").alias("enabled"), combined.contains("mailitemsaccessed").alias("records_reads")).filter("mailbox IS NOT NULL")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, kind of the exports below a folder, by identify(): names come from the listing, columns from each file's first line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    first = spark.read.option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("p"), "value", F.col("_metadata.file_block_start").alias("b"))
    heads = first.filter("b = 0 AND trim(value) <> ''").groupBy("p").agg(F.first("value").alias("head"))
    rows = files.join(heads, F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("p", "^file:/+", "/"), "left")
    head = F.lower(F.coalesce("head", F.lit("")))
    name = F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), " ", "")
    points = []
    for i, (kind, names, columns) in enumerate(KINDS):
        hit = F.lit(False)
        for n in names:
            hit |= name.contains(n)
        score = F.when(hit, 2).otherwise(0) + sum((F.when(head.contains(c), 1).otherwise(0) for c in columns), F.lit(0))
        points.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*points))
    return rows.select("path", F.when(best["score"] > 0, best["kind"]).otherwise("").alias("kind"))
