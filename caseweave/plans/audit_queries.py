"""Audit-log queries over the shared table events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave.operators import audit as O
from caseweave.plans.views import ATTACKERS, AUDIT_BASE, text
from caseweave import config as C

IPS = A.ATTACKER_IPS
#: 2024-01-10, the compromise of the queries.
COMPROMISE = 19732 * 86400
KNOWN_DELEGATES = ("user1", "user2", "user3")
INTENT = ("mail", "hard", "7")


def _top(keys: str, value: str, k: int, source: str = "v_audit", where: str = "true") -> str:
    return f"""(SELECT {keys}, string_agg({value} || ':' || n, ',' ORDER BY n DESC, f) AS top FROM (
      SELECT {keys}, {value}, count(*) AS n, min(event_id) AS f,
        row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, min(event_id)) AS r
      FROM {source} WHERE {where} GROUP BY {keys}, {value}) WHERE r <= {k} GROUP BY {keys})"""


def session_rollup(spark, d):
    return O.session_rollup(A.audit(spark, d), IPS, COMPROMISE)


SESSION_ROLLUP = f"""WITH {AUDIT_BASE}, ops AS {_top('session_id', 'op', 5)}, cl AS {_top('session_id', 'client_info', 1, where="client_info <> ''")},
g AS (SELECT session_id, arg_min(actor, event_id) AS "user", count(DISTINCT ip) AS ips, bool_or(ip IN {ATTACKERS}) AS is_attacker,
  min(sec) AS first_sec, max(sec) AS last_sec, (max(us) - min(us)) // 60000000 AS minutes, count(*) AS events,
  count(*) FILTER (op_lower = 'mailitemsaccessed') AS reads, count(*) FILTER (op_lower IN {text(C.DELETE_OPS)}) AS deletes,
  count(*) FILTER (op_lower IN {text(C.SEND_OPS)}) AS sends, count(*) FILTER (op_lower IN {text(C.RULE_OPS)}) AS rules,
  count(*) FILTER (op_lower IN {text(C.FILE_OPS)}) AS files FROM v_audit GROUP BY session_id)
SELECT g.*, ops.top AS top_operations, coalesce(regexp_replace(cl.top, ':[0-9]+$', ''), '') AS client, ips > 1 AS rotated,
  first_sec >= {COMPROMISE} AS post_compromise FROM g JOIN ops USING (session_id) LEFT JOIN cl USING (session_id)"""


def session_ip_widening(spark, d):
    return O.session_widening(A.audit(spark, d), IPS, ("10.0.3.3",))


SESSION_IP_WIDENING = f"""WITH {AUDIT_BASE} SELECT DISTINCT ip FROM v_audit WHERE session_id IN
  (SELECT session_id FROM v_audit WHERE ip IN {ATTACKERS}) AND ip NOT IN {ATTACKERS} AND ip <> '10.0.3.3'"""


def ip_activity(spark, d):
    return O.ip_activity(A.audit(spark, d), IPS)


IP_ACTIVITY = f"""WITH {AUDIT_BASE}, t AS {_top('ip', 'op', 8)}
SELECT ip, count(*) AS events, count(DISTINCT actor) AS users, min(sec) AS first_sec, max(sec) AS last_sec, any_value(top) AS operations,
  ip IN {ATTACKERS} AS is_attacker FROM v_audit JOIN t USING (ip) GROUP BY ip"""


def client_profile(spark, d):
    return O.client_profile(A.audit(spark, d), IPS)


CLIENT_PROFILE = f"""WITH {AUDIT_BASE}, c AS (SELECT ip, CASE WHEN client_info = '' THEN 'unknown' WHEN contains(lower(client_info), 'restsystem') THEN 'system'
  WHEN contains(lower(client_info), 'outlook mobile') THEN 'mobile' WHEN contains(lower(client_info), 'client=owa') THEN 'owa' ELSE 'other' END AS class FROM v_audit)
SELECT ip, count(*) AS events, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, bool_or(class NOT IN ('system', 'unknown')) AS person_client,
  bool_and(class IN ('system', 'unknown')) AND bool_or(class = 'system') AS system_only, ip IN {ATTACKERS} AS is_attacker FROM c GROUP BY ip"""


def _reads(spark, d):
    kind = F.when(F.col("k") % 4 == 0, "sync").when(F.col("k") % 4 < 3, "bind")
    return A.audit(spark, d).filter("op_lower = 'mailitemsaccessed'").withColumns({"access_type": kind, "throttled": F.col("k") > 90})


def access_profile(spark, d):
    return O.access_profile(_reads(spark, d), IPS)


ACCESS_PROFILE = f"""WITH {AUDIT_BASE}, r AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'sync' WHEN k % 4 < 3 THEN 'bind' END AS t, k > 90 AS thr FROM v_audit WHERE op_lower = 'mailitemsaccessed'),
b AS (SELECT 'all' AS who, * FROM r UNION ALL SELECT 'attacker', * FROM r WHERE ip IN {ATTACKERS})
SELECT who, count(*) AS events, count(*) FILTER (t = 'sync') AS sync, count(*) FILTER (t = 'bind') AS bind, count(*) FILTER (t IS NULL) AS untyped,
  count(*) FILTER (thr) AS throttled, min(sec) FILTER (thr) AS throttled_first FROM b GROUP BY who"""


def delegate_access(spark, d):
    e = A.audit(spark, d).withColumns({"logon_type": (F.col("k") % 3).cast("int"), "mailbox_owner": F.concat(F.lit("user"), F.col("k") % 5)})
    return O.delegate_access(e, KNOWN_DELEGATES, IPS)


DELEGATE_ACCESS = f"""WITH {AUDIT_BASE}, e AS (SELECT *, 'user' || (k % 5) AS owner FROM v_audit WHERE k % 3 = 2)
SELECT actor AS principal, count(*) AS events, count(DISTINCT owner) AS mailboxes, count(DISTINCT op) AS operations, count(DISTINCT ip) AS ips, min(sec) AS first_sec,
  max(sec) AS last_sec, bool_or(ip IN {ATTACKERS}) AS from_attacker_ip, actor IN {text(KNOWN_DELEGATES)} AS known_delegate FROM e WHERE actor <> owner GROUP BY actor"""


def file_activity(spark, d):
    return O.file_activity(A.audit(spark, d).withColumn("object_id", F.col("k").cast("string")), IPS)


FILE_ACTIVITY = f"""WITH {AUDIT_BASE}, f AS (SELECT *, ip IN {ATTACKERS} AS atk FROM v_audit WHERE op_lower IN {text(C.FILE_OPS)})
SELECT count(*) AS total, count(*) FILTER (atk) AS attacker_events, count(*) FILTER (atk AND op_lower IN {text(C.EXFIL_OPS)}) AS exfil,
  count(DISTINCT k) FILTER (atk AND op_lower IN {text(C.EXFIL_OPS)}) AS exfil_files, count(*) FILTER (atk AND op_lower IN {text(C.SHARE_OPS)}) AS shared,
  count(*) FILTER (atk AND op_lower = 'filesyncdownloadedfull') AS full_sync FROM f"""


def audit_coverage(spark, d):
    cover = O.coverage(A.audit(spark, d))
    return cover.crossJoin(O.coverage_warnings(cover, COMPROMISE - 30 * 86400, COMPROMISE + 90 * 86400, 19723 * 86400 + 3600, 60))


AUDIT_COVERAGE = f"""WITH {AUDIT_BASE}, c AS (SELECT count(*) AS events, count(*) FILTER (sec IS NULL) AS without_time, min(sec) AS first_sec, max(sec) AS last_sec,
  (max(sec) - min(sec)) // 86400 AS span_days, count(DISTINCT op) AS operations, count(DISTINCT actor) AS mailboxes, count(DISTINCT ip) AS ips FROM v_audit),
w AS (SELECT 'high' AS severity, 'corpus begins ' || ((first_sec - {COMPROMISE - 30 * 86400}) // 86400) || ' days before the log' AS text FROM c WHERE first_sec > {COMPROMISE - 30 * 86400}
  UNION ALL SELECT 'medium', 'log ends ' || (({COMPROMISE + 90 * 86400} - last_sec) // 86400) || ' days before the corpus' FROM c WHERE last_sec < {COMPROMISE + 90 * 86400}
  UNION ALL SELECT 'high', 'compromise falls in the first day of the log' FROM c WHERE {19723 * 86400 + 3600} - first_sec <= 86400
  UNION ALL SELECT 'medium', 'log spans ' || span_days || ' of 60 days' FROM c WHERE span_days < 60)
SELECT c.*, w.* FROM c, w"""


def rule_republish(spark, d):
    e = A.audit(spark, d).filter("op_lower = 'new-inboxrule'")
    return O.rule_republish(e.select("event_id", "us", F.concat_ws("|", "actor", F.col("k").cast("string")).alias("fingerprint")))


RULE_REPUBLISH = f"""WITH {AUDIT_BASE}, e AS (SELECT event_id, us, actor || '|' || k AS fingerprint FROM v_audit WHERE op_lower = 'new-inboxrule')
SELECT event_id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY us, event_id) > 1 AS repeated FROM e"""


def search_intent(spark, d):
    return O.search_intent(A.audit(spark, d).withColumn("query", F.concat("op", F.lit(" "), "k")), INTENT, IPS)


SEARCH_INTENT = f"""WITH {AUDIT_BASE}, s AS (SELECT event_id, ip, lower(op || ' ' || k) AS q FROM v_audit)
SELECT event_id, concat_ws(',', {', '.join(f"CASE WHEN contains(q, '{t}') THEN '{t}' END" for t in INTENT)}) AS intent, ip IN {ATTACKERS} AS by_attacker FROM s"""


def rule_cleanup(spark, d):
    e = A.audit(spark, d).withColumn("name", F.concat(F.lit(" Rule"), F.col("k").cast("string")))
    rules = e.filter("op_lower = 'new-inboxrule'")
    return O.rule_cleanup(rules, e.filter("op_lower = 'send' AND k % 2 = 0"), e.filter("op_lower = 'harddelete' AND event_id % 5 = 0"))


RULE_CLEANUP = f"""WITH {AUDIT_BASE}, e AS (SELECT *, 'rule' || k AS name FROM v_audit),
m AS (SELECT name, count(*) AS creations FROM e WHERE op_lower = 'new-inboxrule' GROUP BY name)
SELECT name, creations, name IN (SELECT name FROM e WHERE op_lower = 'harddelete' AND event_id % 5 = 0) AS removal_logged
FROM m WHERE name NOT IN (SELECT name FROM e WHERE op_lower = 'send' AND k % 2 = 0)"""

QUERIES = {f.__name__: f for f in (session_rollup, session_ip_widening, ip_activity, client_profile, access_profile, delegate_access, file_activity, audit_coverage, rule_republish, search_intent, rule_cleanup)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
