"""Sign-in queries over the shared table events, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave.operators import signin as S
from caseweave.plans.views import ATTACKERS, SIGNINS

IPS = A.ATTACKER_IPS


def device_code_groups(spark, d):
    return S.device_code_groups(A.signins(spark, d))


DEVICE_CODE_GROUPS = f"""WITH {SIGNINS}, g AS (SELECT corr, arg_min("user", us) AS "user", count(*) AS legs, count(DISTINCT ip) AS i, count(DISTINCT country) AS c,
  count(DISTINCT asn) AS n, count(DISTINCT agent) AS a, count(*) FILTER (interactive) AS inter FROM v_signin GROUP BY corr)
SELECT corr, "user", legs, concat_ws(',', CASE WHEN i > 1 THEN 'IP' END, CASE WHEN c > 1 THEN 'country' END, CASE WHEN n > 1 THEN 'ASN' END, CASE WHEN a > 1 THEN 'user agent' END) AS differs,
  CASE WHEN i > 1 OR c > 1 OR n > 1 THEN 'attack' WHEN legs = 1 THEN 'single' ELSE 'consistent' END AS verdict, inter > 0 AND inter < legs AS attributable FROM g"""


def user_profiles(spark, d):
    return S.user_profiles(A.signins(spark, d)).withColumn("rare", S.rare(F.col("seen"), F.col("n")))


_PROFILES = """p AS (SELECT "user", kind, value, count(*) AS seen, sum(count(*)) OVER (PARTITION BY "user", kind) AS n FROM (
  SELECT "user", 'asn' AS kind, asn AS value FROM v_signin WHERE ok UNION ALL SELECT "user", 'country', country FROM v_signin WHERE ok
  UNION ALL SELECT "user", 'agent', agent FROM v_signin WHERE ok) GROUP BY "user", kind, value)"""
USER_PROFILES = f"""WITH {SIGNINS}, {_PROFILES} SELECT "user", kind, value, seen, CAST(n AS BIGINT) AS n, n >= 5 AND seen <= greatest(2.0, n * 0.05) AS rare FROM p"""


def aitm_score(spark, d):
    s = A.signins(spark, d).withColumns({"transfer": F.when(F.col("asn") == "3", "deviceCodeFlow").otherwise(""), "token_claim": F.col("event_id") % 3 == 0, "single_factor": F.col("event_id") % 5 < 2, "risk": F.when(F.col("event_id") % 10 == 0, "High").otherwise("none")})
    return S.aitm_scores(s)


AITM_SCORE = f"""WITH {SIGNINS}, {_PROFILES}, r AS (SELECT *, n >= 5 AND seen <= greatest(2.0, n * 0.05) AS rare FROM p)
SELECT event_id, s."user", ip, score, score >= 6 AS indicated FROM (SELECT s.*, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN event_id % 5 < 2 THEN 2 ELSE 0 END
  + CASE WHEN a.rare THEN 3 ELSE 0 END + CASE WHEN c.rare THEN 2 ELSE 0 END + CASE WHEN g.rare THEN 1 ELSE 0 END + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS score
  FROM v_signin s LEFT JOIN r a ON a.kind = 'asn' AND a."user" = s."user" AND a.value = asn LEFT JOIN r c ON c.kind = 'country' AND c."user" = s."user" AND c.value = country
  LEFT JOIN r g ON g.kind = 'agent' AND g."user" = s."user" AND g.value = agent WHERE ok AND asn <> '3') s"""


def mfa_fatigue(spark, d):
    return S.mfa_fatigue(A.signins(spark, d), window_sec=7 * 86400, least=5)


MFA_FATIGUE = f"""WITH {SIGNINS}, g AS (SELECT "user", ip, count(*) AS prompts, min(sec) AS first_sec, max(sec) AS last_sec FROM v_signin WHERE code = '50074' GROUP BY "user", ip)
SELECT g."user", g.ip, prompts, first_sec, last_sec, min(s.sec) AS approved_sec FROM g JOIN v_signin s ON s.ok AND s."user" = g."user" AND s.ip = g.ip AND s.sec BETWEEN last_sec AND last_sec + {7 * 86400}
WHERE prompts >= 5 AND last_sec - first_sec <= {28 * 86400} GROUP BY ALL"""


def password_spray(spark, d):
    return S.password_spray(A.signins(spark, d), 12 * 3600, 3, "ip_wide")


PASSWORD_SPRAY = f"""WITH {SIGNINS}, b AS (SELECT * FROM v_signin WHERE code = '50126'),
w AS (SELECT a.ip_wide, a.event_id, count(DISTINCT b."user") AS users FROM b a JOIN b ON a.ip_wide = b.ip_wide AND b.sec BETWEEN a.sec - 43200 AND a.sec GROUP BY a.ip_wide, a.event_id)
SELECT ip_wide, max(users) AS users_hit, (SELECT count(*) FROM b WHERE b.ip_wide = w.ip_wide) AS failures, (SELECT min(sec) FROM b WHERE b.ip_wide = w.ip_wide) AS first_sec,
  (SELECT max(sec) FROM b WHERE b.ip_wide = w.ip_wide) AS last_sec FROM w GROUP BY ip_wide HAVING max(users) >= 3"""


def legacy_auth(spark, d):
    app = F.element_at(F.array(F.lit("IMAP4"), F.lit("Browser"), F.lit("Authenticated SMTP"), F.lit("POP3"), F.lit(None)), (F.col("event_id") % 5 + 1).cast("int"))
    return S.legacy_auth(A.signins(spark, d).withColumn("client_app", app), ("user1", "User2"), IPS)


LEGACY_AUTH = f"""WITH {SIGNINS}, s AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'imap4' WHEN 2 THEN 'authenticated smtp' WHEN 3 THEN 'pop3' END AS protocol FROM v_signin)
SELECT protocol, count(*) AS total, count(*) FILTER (ok) AS successes, count(*) FILTER (ok AND ("user" IN ('user1', 'user2') OR ip IN {ATTACKERS})) AS indicated FROM s WHERE protocol IS NOT NULL GROUP BY protocol"""


def single_leg_scores(spark, d):
    app = F.concat(F.lit("app"), F.least(F.col("event_id") % 40, F.lit(9)))
    s = A.signins(spark, d).withColumns({"app": app, "expected": app == "app9", "single_factor": F.col("event_id") % 3 == 0, "token_claim": F.col("event_id") % 7 < 3, "no_access_policy": F.col("event_id") % 2 == 0, "agent": F.when(F.col("event_id") % 11 == 0, "Python-Requests/2").otherwise("Edge")})
    return S.single_leg_scores(s)


SINGLE_LEG_SCORES = f"""WITH {SIGNINS}, l AS (SELECT *, 'app' || least(event_id % 40, 9) AS app FROM v_signin), n AS (SELECT app, count(*) AS seen FROM l GROUP BY app),
s AS (SELECT corr, l.app, CASE WHEN l.app <> 'app9' AND seen <= greatest(2.0, 0.01 * (SELECT count(*) FROM l)) THEN 3 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END
  + CASE WHEN event_id % 7 < 3 THEN 3 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN ok THEN 1 ELSE 0 END AS raw
  FROM l JOIN n USING (app) WHERE corr IN (SELECT corr FROM l GROUP BY corr HAVING count(*) = 1))
SELECT corr, app, CASE WHEN app = 'app9' THEN least(raw, 5) ELSE raw END AS score, CASE WHEN app = 'app9' THEN least(raw, 5) ELSE raw END >= 6 AS indicated FROM s"""


def page_cap_truncation(spark, d):
    """Four exports, by the k of their events: one whole, one of full pages, one that ends on a short page, one file alone."""
    k = F.col("k")
    size = F.when(k % 4 == 3, 500).when((k % 4 == 2) & (k == 98), 312).when(k % 4 == 0, 100 + k).otherwise(1000)
    one = A.audit(spark, d).groupBy("k").agg(F.lit(1).alias("one")).select((k % 4).alias("export"), F.when(k % 4 == 3, 3).otherwise(k).alias("file"), size.alias("n")).distinct()
    return reduce(lambda x, y: x.unionByName(y), [S.page_cap(one.filter(F.col("export") == e)).withColumn("export", F.lit(e).cast("long")) for e in range(4)])


PAGE_CAP_TRUNCATION = f"""WITH {SIGNINS}, f AS (SELECT DISTINCT k % 4 AS export, CASE WHEN k % 4 = 3 THEN 3 ELSE k END AS file, CASE WHEN k % 4 = 3 THEN 500 WHEN k = 98 THEN 312 WHEN k % 4 = 0 THEN 100 + k ELSE 1000 END AS n FROM v_audit),
c AS (SELECT export, count(*) AS files, CAST(sum(n) AS BIGINT) AS records, min(n) AS smallest, max(n) AS largest, max(file) AS last FROM f GROUP BY export),
p AS (SELECT export, n AS page_cap, count(*) AS files_at_cap, row_number() OVER (PARTITION BY export ORDER BY count(*) DESC, n) AS r FROM f WHERE n IN (500, 999, 1000, 5000, 10000) GROUP BY export, n),
x AS (SELECT c.*, coalesce(page_cap, 0) AS page_cap, coalesce(files_at_cap, 0) AS files_at_cap FROM c LEFT JOIN p ON p.export = c.export AND r = 1),
y AS (SELECT *, page_cap > 0 AND files_at_cap = files AS all_at_cap, files - files_at_cap = 1 AND (SELECT n FROM f WHERE f.export = x.export AND f.file = x.last) <> page_cap AS last_short FROM x)
SELECT export, files, records, smallest, largest, page_cap, files_at_cap, all_at_cap, (all_at_cap AND files >= 2) OR (NOT all_at_cap AND page_cap > 0 AND files_at_cap >= greatest(2, 0.8 * files) AND largest = page_cap AND NOT last_short) AS suspected FROM y"""


def _elsewhere(spark, d):
    """All sign-ins, from addresses that overlap with the audit log's in part."""
    return A.signins(spark, d).withColumn("ip", F.concat(F.lit("10.0."), "asn", F.lit("."), F.col("event_id") % 10))


def token_replay(spark, d):
    return S.token_replay(A.audit(spark, d), _elsewhere(spark, d), ("mailitemsaccessed", "send"))


TOKEN_REPLAY = f"""WITH {SIGNINS}, s AS (SELECT ok, sec, '10.0.' || asn || '.' || (event_id % 10) AS ip FROM v_signin)
SELECT ip, count(*) AS events, count(*) FILTER (op_lower IN ('mailitemsaccessed', 'send')) AS token_events, min(sec) AS first_sec, max(sec) AS last_sec FROM v_audit
WHERE sec BETWEEN (SELECT min(sec) FROM s) AND (SELECT max(sec) FROM s) AND ip NOT IN (SELECT ip FROM s WHERE ok) GROUP BY ip
HAVING count(*) >= 3 AND count(*) FILTER (op_lower IN ('mailitemsaccessed', 'send')) > 0"""


def short_agents(spark, d):
    """The client that each sign-in's agent names, over agents made of the event."""
    kinds = ("Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0", "python-requests/2.31 CURL", "Mozilla/5.0 (iPhone) Mobile/15E148 Safari/604.1", "Outlook-iOS/2.0", "")
    agent = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("event_id") % 5 + 1).cast("int"))
    return A.signins(spark, d).select("event_id", S.short_agent(agent, 30).alias("client"))


SHORT_AGENTS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Chrome/120.0 Safari/537.36 Edg' WHEN 1 THEN 'python-requests/2.31 CURL' WHEN 2 THEN 'Safari/604.1' WHEN 3 THEN 'Outlook-iOS/2.0' ELSE '?' END AS client FROM events"""

QUERIES = {f.__name__: f for f in (device_code_groups, user_profiles, aitm_score, mfa_fatigue, password_spray, legacy_auth, single_leg_scores, page_cap_truncation, token_replay, short_agents)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
