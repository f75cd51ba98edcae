"""Queries over headers, the directory, persistence and reports, on values made of the shared tables' own, and their SQL.
The SQL states every fixed value by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave.functions import address, auth, files, text, timeparse
from caseweave.operators import audit as O
from caseweave.operators import baseline as B
from caseweave.operators import enrich as E
from caseweave.operators import identity as I
from caseweave.operators import joins as J
from caseweave.operators import report as Q
from caseweave.operators import signin as S
from caseweave.plans.views import ATTACKERS, AUDIT_BASE, CORRESPONDENCE, MESSAGES, SIGNINS

IPS = A.ATTACKER_IPS


def _pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _case(values, by):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{by} % {len(values)} + 1]"


_RESULTS = ("mx; dmarc=pass; spf=fail", "mx; spf=pass; dkim=pass", "mx; spf=pass", "mx; spf=softfail", "mx; dmarc=fail reason=\"p reject\"; spf=pass; dkim=pass", "mx; spf=fail; dkim=fail", "mx; compauth=fail; spf=pass", "nothing", "mx; spf=none; dkim=pass")


def auth_states(spark, d):
    m = A.audit(spark, d).withColumn("detail", auth.auth_detail(F.array(_pick(_RESULTS, F.col("event_id")))))
    flags = auth.auth_flags(F.col("detail"), F.array().cast("array<string>"))
    return m.select("event_id", auth.auth_state(flags).alias("state"), auth.fail_reason(F.col("detail")).alias("reason"))


AUTH_STATES = """SELECT event_id, ['aligned', 'aligned', 'partial', 'failed', 'failed', 'failed', 'failed', 'absent', 'partial'][event_id % 9 + 1] AS state,
  ['spf=fail', '', '', 'spf=softfail', 'dmarc=fail p reject', 'spf=fail; dkim=fail', 'compauth=fail', '', 'spf=none'][event_id % 9 + 1] AS reason FROM events"""


def mail_dates(spark, d):
    """Date headers and log times in several spellings of each event's time, and the seconds that they mean."""
    e = A.table(spark, d, "events").withColumn("us", A.micros(F.col("ts"))).withColumn("t", F.timestamp_seconds(F.expr("us div 1000000")))
    forms = ["EEE, d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
    spelled = [F.concat(F.date_format("t", forms[0]), F.lit(" +0000")), F.concat(F.date_format("t", forms[1]), F.lit(" GMT (UTC)")), F.concat(F.date_format("t", forms[2]), F.lit("Z")), F.lit("not a date")]
    header = F.element_at(F.array(*spelled), (F.col("event_id") % 4 + 1).cast("int"))
    iso = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("t", forms[2]), F.lit(".1234567Z"))).otherwise(F.date_format("t", "M/d/yyyy H:mm:ss"))
    return e.select("event_id", F.unix_seconds(timeparse.parse_rfc2822(header)).alias("header_sec"), F.unix_seconds(timeparse.parse_iso(iso)).alias("log_sec"))


MAIL_DATES = """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN epoch_us(ts) // 1000000 END AS header_sec, epoch_us(ts) // 1000000 AS log_sec FROM events"""

_ACTIVITIES = ("Consent to application", "Add service principal credentials.", "Add service principal.", "User registered security info", "Add device", "Set domain authentication", "Update user", "Delete conditional access policy", "User deleted security info")


def _directory(spark, d):
    e = A.audit(spark, d)
    permission = _pick(("Mail.Read offline_access", "User.Read", "Files.Read.All, Sites.Read.All", "", "mailboxsettings.read"), F.col("k"))
    return e.select(F.col("event_id").alias("id"), _pick(_ACTIVITIES, F.col("event_id")).alias("activity"), _pick(("success", "success", "failure"), F.col("k")).alias("result"), "sec", "actor", "ip", F.concat(F.lit("App "), F.col("k") % 10).alias("target"), permission.alias("permission"))


_DIRECTORY = f"""{AUDIT_BASE}, da0 AS (SELECT event_id AS id, {_case(_ACTIVITIES, 'event_id')} AS activity, ['success', 'success', 'failure'][k % 3 + 1] AS result, sec, actor, ip, 'App ' || (k % 10) AS target, k % 5 AS p,
  ['oauth_consent', 'sp_credential', 'service_principal', 'mfa_method', 'device', 'federation', NULL, 'ca_policy', 'mfa_removed'][event_id % 9 + 1] AS kind,
  ['survives', 'survives', 'survives', 'conditional', 'no', 'tenant', NULL, 'survives', 'no'][event_id % 9 + 1] AS password, ['survives', 'survives', 'survives', 'survives', 'partial', 'tenant', NULL, 'survives', 'no'][event_id % 9 + 1] AS token FROM v_audit),
da AS (SELECT *, ['mail.read', '', '', '', 'mailboxsettings.read'][p + 1] AS mail, ['', '', 'files.read.all,sites.read.all', '', ''][p + 1] AS high, ['offline_access', '', '', '', ''][p + 1] AS durable, [true, true, true, false, true][p + 1] AS readable FROM da0 WHERE kind IS NOT NULL AND result <> 'failure')"""


def directory_activities(spark, d):
    r = I.directory_audit(_directory(spark, d))
    return r.select("id", "kind", "password", "token", *[F.array_join(f"scopes.{k}", ",").alias(k) for k in ("mail", "high", "durable")], "scopes.readable")


DIRECTORY_ACTIVITIES = f"WITH {_DIRECTORY} SELECT id, kind, password, token, mail, high, durable, readable FROM da"


def persistence_events(spark, d):
    p = I.persistence(I.directory_audit(_directory(spark, d)), IPS, 1704100000, None, ("user1", "user2"))
    return p.select("id", "kind", "by_attacker", "severity")


_PERSISTENCE = f"""{_DIRECTORY}, pe AS (SELECT *, ip IN {ATTACKERS} OR (sec >= 1704100000 AND (contains(actor, 'user1') OR contains(actor, 'user2'))) AS by_attacker,
  CASE WHEN password = 'tenant' OR (password = 'survives' AND token = 'survives') THEN 'high' WHEN password IN ('survives', 'conditional') OR token IN ('survives', 'conditional') THEN 'medium' ELSE 'low' END AS severity FROM da)"""
PERSISTENCE_EVENTS = f"WITH {_PERSISTENCE} SELECT id, kind, by_attacker, severity FROM pe WHERE NOT (kind = 'oauth_consent' AND NOT by_attacker AND mail = '' AND high = '' AND readable)"


def remediation_plan(spark, d):
    return I.remediation_plan(I.persistence(I.directory_audit(_directory(spark, d)), IPS, 1704100000, None, ("user1", "user2"))).select("kind", "target", "by_attacker", "sources")


REMEDIATION_PLAN = f"""WITH {_PERSISTENCE} SELECT kind, target, bool_or(by_attacker) AS by_attacker, 'entra_audit' AS sources FROM pe WHERE NOT (kind = 'oauth_consent' AND NOT by_attacker AND mail = '' AND high = '' AND readable) GROUP BY kind, target"""


def _hops(spark, d):
    return A.audit(spark, d).select(F.col("k").alias("path"), "ip", _pick(("DE", "us", "FR", ""), F.col("event_id")).alias("country"), _pick(("Some Net", "BulletProof Hosting", "Aeza Intl", "Uni", "ISP"), F.col("k")).alias("org"))


def geo_findings(spark, d):
    return E.geo_findings(_hops(spark, d), ("DE", "US")).select("path", F.col("weight").cast("long").alias("weight"), "countries", "abusive")


GEO_FINDINGS = f"""WITH {AUDIT_BASE}, h AS (SELECT k AS path, bool_or(event_id % 4 = 2) AS fr, k % 5 IN (1, 2) AS abusive FROM v_audit GROUP BY k)
SELECT path, CAST(CASE WHEN fr THEN 2 ELSE 0 END + CASE WHEN abusive THEN 4 ELSE 0 END AS BIGINT) AS weight, CASE WHEN fr THEN 'FR' ELSE '' END AS countries, abusive FROM h WHERE fr OR abusive"""


def address_countries(spark, d):
    s = A.signins(spark, d)
    history = s.filter("asn IN ('1', '2')").select("user", F.concat(F.lit("c"), "country").alias("country"))
    return E.address_countries(A.audit(spark, d).select("ip", F.col("actor").alias("user"), F.concat(F.lit("C"), F.col("k") % 5).alias("country")), history, ("C1",))


ADDRESS_COUNTRIES = f"""WITH {SIGNINS}, h AS (SELECT DISTINCT "user", 'C' || country AS c FROM v_signin WHERE asn IN ('1', '2')), a AS (SELECT DISTINCT ip, actor, 'C' || (k % 5) AS country FROM v_audit),
g AS (SELECT ip, country, bool_or(actor IN (SELECT "user" FROM h)) AS has, bool_or((actor, country) IN (SELECT ("user", c) FROM h)) AS seen FROM a GROUP BY ip, country)
SELECT ip, country, CASE WHEN has THEN NOT seen ELSE country <> 'C1' END AS unexpected, CASE WHEN has THEN 'user' ELSE 'global' END AS basis FROM g"""


def subjects_normalized(spark, d):
    m = A.messages(spark, d)
    s = F.concat(_pick(("Re: ", "FW:RE:  ", "", "fwd : "), F.col("path")), "subject")
    return m.select("path", F.md5(text.normalize_subject(s)).alias("subject"), F.md5(text.snippet(F.col("body"), 80)).alias("snippet"))


SUBJECTS_NORMALIZED = rf"""WITH {MESSAGES}, c AS (SELECT path, lower(trim(regexp_replace(regexp_replace({_case(("Re: ", "FW:RE:  ", "", "fwd : "), 'path')} || subject, '(?i)^(\s*(re|fw|fwd)\s*:\s*)+', ''), '\s+', ' ', 'g'))) AS s, trim(regexp_replace(body, '\s+', ' ', 'g')) AS b FROM v_msg)
SELECT path, md5(s) AS subject, md5(CASE WHEN length(b) > 80 THEN rtrim(substr(b, 1, 80)) || '...' ELSE b END) AS snippet FROM c"""


def header_addresses(spark, d):
    c = A.table(spark, d, "customer")
    header = F.concat(F.lit('"'), "c_name", F.lit('" <'), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Mail."), _pick(("a.co.uk", "B.example", "10.0.0.1"), F.col("c_custkey")), F.lit(">"))
    mail = address.normalize_email(header)
    return c.select("c_custkey", mail.alias("address"), address.registrable_domain(address.domain_of(mail)).alias("domain"), address.normalize_message_id(F.concat(F.lit(" <ID"), "c_custkey", F.lit("@X> "))).alias("message_id"), text.name_key(F.col("c_name")).alias("name_key"))


HEADER_ADDRESSES = """SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@mail.' || ['a.co.uk', 'b.example', '10.0.0.1'][c_custkey % 3 + 1] AS address, ['a.co.uk', 'b.example', '0.1'][c_custkey % 3 + 1] AS domain,
  '<id' || c_custkey || '@x>' AS message_id, array_to_string(list_sort([lower(split_part(c_name, '#', 1)), split_part(c_name, '#', 2)]), ' ') AS name_key FROM customer"""


def attachment_names(spark, d):
    a = A.attachments(spark, d)
    name = F.concat("name", _pick((" (2).PDF", " - Copy.pdf", ".pdf", ".docm", ".pdf.exe"), F.expr("thread")))
    none = F.array().cast("array<string>")
    return a.select("path", files.attachment_key(name).alias("key"), F.array_join(files.name_flags(name, F.lit("pdf"), none), ",").alias("flags"), auth.folder_hint(F.concat(F.lit("box/"), _pick(("Deleted Items", "Junk", "Inbox", "RSS Feeds"), F.col("thread")))).alias("folder"))


ATTACHMENT_NAMES = """SELECT l_orderkey || '-' || l_linenumber AS path, 'part' || (l_partkey % 20) || ['.pdf', '.pdf', '.pdf', '.docm', '.pdf.exe'][l_orderkey % 5 + 1] AS key,
  ['', '', '', 'macro extension,content does not match the extension', 'double extension,executable extension,content does not match the extension'][l_orderkey % 5 + 1] AS flags, ['deleted', 'moved', '', 'moved'][l_orderkey % 4 + 1] AS folder FROM lineitem"""


def known_contacts(spark, d):
    return B.known_contacts(A.correspondence(spark, d))


KNOWN_CONTACTS = f"WITH {CORRESPONDENCE} SELECT DISTINCT sender FROM v_corr"


def corpus_span(spark, d):
    return B.corpus_span(A.audit(spark, d))


CORPUS_SPAN = f"WITH {AUDIT_BASE} SELECT count(sec) AS timed, min(sec) AS first_sec, max(sec) AS last_sec, (max(sec) - min(sec)) // 86400 AS days FROM v_audit"


def subject_senders(spark, d):
    e = A.audit(spark, d).withColumn("subjects", F.array(F.concat(F.lit("RE: Offer "), F.col("k") % 9)))
    return O.subject_senders(e, ("offer 3", "Offer  5"), 1704200000)


SUBJECT_SENDERS = f"WITH {AUDIT_BASE} SELECT ip, count(*) AS sends FROM v_audit WHERE op_lower = 'send' AND sec >= 1704200000 AND k % 9 IN (3, 5) GROUP BY ip"


def completeness(spark, d):
    return Q.completeness(J.deleted_absent(A.audit(spark, d), A.messages(spark, d).filter("sender LIKE 'en@%'")))


COMPLETENESS = f"""WITH {AUDIT_BASE}, {MESSAGES}, x AS (SELECT DISTINCT message_id, message_id IN (SELECT message_id FROM v_msg WHERE sender LIKE 'en@%') AS present FROM v_audit WHERE op_lower IN ('harddelete', 'softdelete', 'movetodeleteditems'))
SELECT count(*) AS deleted, count(*) FILTER (NOT present) AS absent, count(*) FILTER (NOT present) = 0 AS complete FROM x"""


def resolved_groups(spark, d):
    s = A.signins(spark, d)
    return S.resolve_single_groups(S.device_code_groups(s), s, IPS).select("corr", "verdict", F.array_join("matched_ips", ",").alias("matched_ips"))


RESOLVED_GROUPS = f"""WITH {SIGNINS}, g AS (SELECT corr, count(*) AS legs, count(DISTINCT ip) > 1 OR count(DISTINCT country) > 1 OR count(DISTINCT asn) > 1 AS located, min(ip) AS ip FROM v_signin GROUP BY corr)
SELECT corr, CASE WHEN located OR (legs = 1 AND ip IN {ATTACKERS}) THEN 'attack' WHEN legs = 1 THEN 'single' ELSE 'consistent' END AS verdict, CASE WHEN NOT located AND legs = 1 AND ip IN {ATTACKERS} THEN ip ELSE '' END AS matched_ips FROM g"""


def name_mismatches(spark, d):
    c = A.table(spark, d, "customer")
    name = F.concat(_pick(("Anna ", "The ", "Custom "), F.col("c_custkey")), F.lit("Customer"))
    mail = F.concat(_pick(("anna.b", "customer7", "x9"), F.floor(F.col("c_custkey") / 3)), F.lit("@x.example"))
    return c.select("c_custkey", E.name_mismatch(name, mail).alias("mismatch"))


NAME_MISMATCHES = """SELECT c_custkey, CASE c_custkey // 3 % 3 WHEN 0 THEN c_custkey % 3 <> 0 WHEN 1 THEN false ELSE true END AS mismatch FROM customer"""

_ALL = (
    auth_states, mail_dates, directory_activities, persistence_events, remediation_plan, geo_findings, address_countries, subjects_normalized, header_addresses, attachment_names, known_contacts, corpus_span, subject_senders, completeness,
    resolved_groups, name_mismatches,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
