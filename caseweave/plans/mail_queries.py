"""Queries over mail, its bodies and its joins with the logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave import config as C
from caseweave.operators import baseline as B
from caseweave.operators import body as X
from caseweave.operators import joins as J
from caseweave.plans.views import ATTACHMENTS, ATTACKERS, AUDIT_BASE, CORRESPONDENCE, MESSAGES, SIGNINS, text

IPS = A.ATTACKER_IPS
KEYWORDS = ("license", "the", "worthless", "queeux", "zzz")
RULES = [{"name": "r1", "created_day": 19800, "subject": ("the",)}, {"name": "r2", "created_day": 19750, "body": ("license", "token"), "sender": ("fr@",)}, {"name": "r3", "created_day": 0, "body": ("zzzz",)}]
LOW = {"boiler_senders": 2, "burst_count": 2, "burst_hours": 24.0 * 200}


def domain_baseline(spark, d):
    return B.domain_baseline(A.correspondence(spark, d))


DOMAIN_BASELINE = f"""WITH {CORRESPONDENCE}, g AS (SELECT sender_domain, count(*) AS n, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (auth IN ('pass', 'fail')) AS auth_seen, count(*) FILTER (auth = 'pass') AS auth_pass FROM v_corr GROUP BY sender_domain)
SELECT *, auth_seen >= 3 AND auth_pass / auth_seen >= 0.5 AS enforces, n >= 3 AS frequent, n >= 5 AS established, n <= 1 AS first_contact FROM g"""


def frequent_senders(spark, d):
    return B.frequent_senders(A.correspondence(spark, d), 12)


FREQUENT_SENDERS = f"WITH {CORRESPONDENCE} SELECT sender, count(*) AS n FROM v_corr GROUP BY sender HAVING count(*) >= 12"


def internal_domains(spark, d):
    return B.internal_domains(A.correspondence(spark, d), "recipient")


INTERNAL_DOMAINS = f"""WITH {CORRESPONDENCE} SELECT sender_domain AS domain FROM v_corr GROUP BY 1 HAVING count(*) >= 2 UNION SELECT recipient FROM v_corr GROUP BY 1 HAVING count(*) >= 3"""


def dominant_recipient(spark, d):
    return B.scenario(A.correspondence(spark, d), share=0.02)


DOMINANT_RECIPIENT = f"""WITH {CORRESPONDENCE}, c AS (SELECT lower(recipient) AS recipient, count(*) AS n FROM v_corr GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, recipient DESC LIMIT 1), s AS (SELECT recipient, n, n / (SELECT count(*) FROM v_corr) AS share FROM t)
SELECT *, CASE WHEN share >= 0.02 THEN 'ato' ELSE 'impersonation' END AS scenario, CASE WHEN share >= 0.02 THEN 'dominant mailbox' ELSE 'default' END AS reason FROM s"""


def sender_recipient_pairs(spark, d):
    return B.sender_recipient_pairs(A.correspondence(spark, d))


SENDER_RECIPIENT_PAIRS = f"WITH {CORRESPONDENCE} SELECT lower(sender) AS sender, lower(recipient) AS recipient, count(*) AS n FROM v_corr GROUP BY 1, 2"


def sending_ip_anomaly(spark, d):
    return B.sending_ip_anomaly(A.audit(spark, d).withColumn("ip", F.concat_ws(".", "ip", "k")))


SENDING_IP_ANOMALY = f"""WITH {AUDIT_BASE}, p AS (SELECT actor, ip || '.' || k AS ip, count(*) AS seen FROM v_audit GROUP BY 1, 2)
SELECT actor, ip, seen FROM p WHERE seen <= 1 AND actor IN (SELECT actor FROM p GROUP BY actor HAVING sum(seen) >= 3 AND count(*) > 1)"""


def familiarity(spark, d):
    c = A.correspondence(spark, d)
    n = c.groupBy("sender").agg(F.count("*").alias("n"))
    return n.select("sender", B.familiarity(F.col("n")).alias("familiarity"))


FAMILIARITY = f"WITH {CORRESPONDENCE} SELECT sender, CASE WHEN count(*) >= 5 THEN 'established' WHEN count(*) > 1 THEN 'known' ELSE 'new' END AS familiarity FROM v_corr GROUP BY sender"


def rule_keyword_policy(spark, d):
    return B.rule_keyword_policy(A.messages(spark, d), KEYWORDS)


RULE_KEYWORD_POLICY = f"WITH {MESSAGES} " + " UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) FILTER (contains(lower(body), '{k}')) AS hits, count(*) FILTER (contains(lower(body), '{k}')) / count(*) AS share, count(*) FILTER (contains(lower(body), '{k}')) / count(*) > 0.25 AS over_cap FROM v_msg" for k in KEYWORDS)


def _exploded(spark, d):
    return X.exploded_blocks(A.messages(spark, d), separator="\n")


_BLOCKS = f"""{MESSAGES}, b0 AS (SELECT path, sender, day, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 60) AS w FROM v_msg),
b1 AS (SELECT path, sender, day, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS block FROM b0),
b2 AS (SELECT *, pos = n - 1 AS "trailing", substr(sha1(trim(regexp_replace(regexp_replace(regexp_replace(lower(substr(block, 1, 2000)), 'https?://\\S+', ' url ', 'g'), '[0-9]+', '0', 'g'), '\\s+', ' ', 'g'))), 1, 16) AS hash FROM b1),
b3 AS (SELECT hash, count(*) AS n, count(DISTINCT sender) AS senders, min(day) AS first_day, max(day) AS last_day, count(*) FILTER ("trailing") AS "trailing", bool_or(day < 19800) AS pre_compromise, min(sender) AS sender FROM b2 GROUP BY hash)"""


def block_statistics(spark, d):
    return X.block_statistics(_exploded(spark, d), 19800)


BLOCK_STATISTICS = f"WITH {_BLOCKS} SELECT * FROM b3"


def _classified(spark, d):
    from dataclasses import replace

    return X.classify_blocks(X.block_statistics(_exploded(spark, d), 19800), False, replace(C.DEFAULTS, **LOW))


def boilerplate_blocks(spark, d):
    return _classified(spark, d).filter("kind IS NOT NULL").select("hash", "kind", "n")


BOILERPLATE_BLOCKS = f"""WITH {_BLOCKS}, k AS (SELECT hash, n, CASE WHEN n >= 5 AND "trailing" >= n * 0.6 AND senders >= 2 AND last_day - first_day >= 7 THEN 'boilerplate' WHEN n >= 2 AND senders = 1 AND (last_day - first_day) * 24 <= {24 * 200} THEN 'burst' END AS kind FROM b3)
SELECT hash, kind, n FROM k WHERE kind IS NOT NULL"""


def mass_mail_bursts(spark, d):
    return _classified(spark, d).filter("kind = 'burst'").groupBy("sender").agg(F.count("*").alias("blocks"), F.sum("n").alias("copies"))


MASS_MAIL_BURSTS = f"""WITH {_BLOCKS} SELECT sender, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS copies FROM b3
WHERE NOT (n >= 5 AND "trailing" >= n * 0.6 AND senders >= 2 AND last_day - first_day >= 7) AND n >= 2 AND senders = 1 AND (last_day - first_day) * 24 <= {24 * 200} GROUP BY sender"""


def boilerplate_removal(spark, d):
    out = X.strip_boilerplate(_exploded(spark, d), _classified(spark, d))
    return out.select("path", F.md5("text").alias("digest"), "removed")


BOILERPLATE_REMOVAL = f"""WITH {_BLOCKS}, bp AS (SELECT hash FROM b3 WHERE n >= 5 AND "trailing" >= n * 0.6 AND senders >= 2 AND last_day - first_day >= 7),
l AS (SELECT path, max(pos) AS last FROM b2 GROUP BY path), m AS (SELECT b2.*, CASE WHEN (SELECT count(*) FROM bp) > 0 THEN hash IN (SELECT hash FROM bp) ELSE pos >= last - 1 AND regexp_matches(block, '{X.DISCLAIMER}') END AS gone FROM b2 JOIN l USING (path))
SELECT path, md5(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS digest, count(*) FILTER (gone) AS removed FROM m GROUP BY path"""


def quoted_split(spark, d):
    body = F.when(F.col("path") % 3 == 0, F.concat("subject", F.lit("\n> old\n-- Original Message --\n"), "body")).otherwise(F.concat("subject", F.lit("\n> q\nend")))
    s = A.messages(spark, d).withColumn("s", X.split_quoted(body))
    return s.select("path", F.length("s.own").cast("long").alias("own"), F.length("s.quoted").cast("long").alias("quoted"))


QUOTED_SPLIT = f"""WITH {MESSAGES}, q AS (SELECT path, CASE WHEN path % 3 = 0 THEN subject ELSE subject || chr(10) || 'end' END AS own, CASE WHEN path % 3 = 0 THEN '> old' || chr(10) || '-- Original Message --' || chr(10) || body ELSE '> q' END AS quoted FROM v_msg)
SELECT path, length(trim(own)) AS own, length(trim(quoted)) AS quoted FROM q"""


def message_event_join(spark, d):
    return J.message_events(A.messages(spark, d), A.audit(spark, d), IPS)


MESSAGE_EVENT_JOIN = f"""WITH {AUDIT_BASE}, {MESSAGES} SELECT path, count(*) AS matched, count(*) FILTER (ip IN {ATTACKERS}) AS by_attacker, bool_or(ip IN {ATTACKERS} AND op_lower IN {text(C.DELIBERATE_OPS)}) AS confirmed,
  count(DISTINCT op) AS actions, count(*) FILTER (ip IN {ATTACKERS}) > 0 AND NOT bool_or(ip IN {ATTACKERS} AND op_lower IN {text(C.DELIBERATE_OPS)}) AS read_only FROM v_msg m JOIN v_audit a USING (message_id) GROUP BY path"""


def deleted_absent(spark, d):
    """A corpus that lacks mail, as one does after deletion: that of every sender but the English ones."""
    return J.deleted_absent(A.audit(spark, d), A.messages(spark, d).filter("sender LIKE 'en@%'"))


DELETED_ABSENT = f"""WITH {AUDIT_BASE}, {MESSAGES} SELECT message_id, count(*) AS n, message_id IN (SELECT message_id FROM v_msg WHERE sender LIKE 'en@%') AS present FROM v_audit WHERE op_lower IN {text(C.DELETE_OPS)} GROUP BY message_id"""


def attacker_authorship(spark, d):
    return J.attacker_authorship(A.messages(spark, d), A.audit(spark, d), IPS, 19732 * 86400)


ATTACKER_AUTHORSHIP = f"""WITH {AUDIT_BASE}, {MESSAGES}, s AS (SELECT message_id, bool_or(ip IN {ATTACKERS}) AS atk, max(sec) AS last FROM v_audit WHERE op_lower = 'send' GROUP BY message_id)
SELECT path, CASE WHEN atk THEN 'attacker' WHEN last >= {19732 * 86400} THEN 'window' ELSE 'staff' END AS route FROM v_msg JOIN s USING (message_id)"""


def exposure_scope(spark, d):
    reads = A.audit(spark, d).filter("op_lower = 'mailitemsaccessed'").withColumns({"access_type": F.when(F.col("k") % 4 == 0, "sync").otherwise("bind"), "throttled": F.col("k") > 90})
    return J.exposure_scope(A.messages(spark, d), reads, IPS)


EXPOSURE_SCOPE = f"""WITH {AUDIT_BASE}, {MESSAGES}, r AS (SELECT message_id, count(*) AS reads, min(sec) AS first_sec, arg_min(CASE WHEN k % 4 = 0 THEN 'sync' ELSE 'bind' END, us) AS first_access, bool_or(k > 90) AS lower_bound
  FROM v_audit WHERE op_lower = 'mailitemsaccessed' AND ip IN {ATTACKERS} GROUP BY message_id) SELECT r.*, (SELECT count(*) FROM v_msg m WHERE m.message_id = r.message_id) AS copies FROM r"""


def _lures(spark, d):
    s = A.signins(spark, d)
    return s.filter("NOT ok").select(F.col("event_id").alias("id"), "user", "sec"), s.filter("agent = 'purchase'").select(F.col("event_id").alias("id"), "user", "sec")


_LURES = f"{SIGNINS}, l AS (SELECT * FROM v_signin WHERE NOT ok), t AS (SELECT * FROM v_signin WHERE agent = 'purchase')"


def signin_lure_window(spark, d):
    return J.lure_window(*_lures(spark, d), 7200)


SIGNIN_LURE_WINDOW = f"""WITH {_LURES} SELECT l.event_id AS lure, t.event_id AS token, t.sec - l.sec AS gap FROM l JOIN t ON l."user" = t."user" AND l.sec BETWEEN t.sec - 7200 AND t.sec"""


def tokens_without_lure(spark, d):
    return J.tokens_without_lure(*_lures(spark, d), 7200)


TOKENS_WITHOUT_LURE = f"""WITH {_LURES} SELECT event_id AS id FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l."user" = t."user" AND l.sec BETWEEN t.sec - 7200 AND t.sec)"""


def first_lure(spark, d):
    return J.first_lure(*_lures(spark, d), 7200)


FIRST_LURE = f"""WITH {_LURES}, h AS (SELECT l.event_id AS lure, t.event_id AS token, t.sec - l.sec AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY t.sec - l.sec, t.event_id) AS r FROM l JOIN t ON l."user" = t."user" AND l.sec BETWEEN t.sec - 7200 AND t.sec)
SELECT lure, token, gap FROM h WHERE r = 1"""


def rule_replay(spark, d):
    return J.rule_replay(A.messages(spark, d), RULES)


def _rule(r: dict) -> str:
    c = " OR ".join(f"contains(lower({f}), '{w}')" for f in ("subject", "body", "sender") for w in r.get(f, ()))
    return f"SELECT '{r['name']}' AS rule, count(*) FILTER (({c}) AND day < {r['created_day']}) AS before, count(*) FILTER (({c}) AND day >= {r['created_day']}) AS after FROM v_msg"


RULE_REPLAY = f"WITH {MESSAGES} " + " UNION ALL ".join(map(_rule, RULES))


def attachment_substitution(spark, d):
    a = A.attachments(spark, d).withColumns({"sender": F.concat(F.lit("s"), F.col("sha").cast("long") % 4), "domain": F.concat(F.lit("d"), F.col("sha").cast("long") % 3)})
    return J.attachment_substitution(a, 10500)


ATTACHMENT_SUBSTITUTION = f"""WITH {ATTACHMENTS}, a AS (SELECT *, 's' || (CAST(sha AS BIGINT) % 4) AS sender, 'd' || (CAST(sha AS BIGINT) % 3) AS domain, row_number() OVER (PARTITION BY thread, name ORDER BY day, path) AS r FROM v_att),
x AS (SELECT a.*, f.path AS original, f.sha AS original_sha, CASE WHEN a.day < 10500 THEN 0 WHEN f.day < 10500 THEN 3 ELSE 2 END + CASE WHEN a.domain <> f.domain THEN 3 WHEN a.sender <> f.sender THEN 1 ELSE 0 END AS score
  FROM a JOIN a f ON f.r = 1 AND a.thread = f.thread AND a.name = f.name AND a.sha <> f.sha) SELECT thread, name, original, path, original_sha, sha, score, score >= 5 AS indicated FROM x"""


def message_trace_gap(spark, d):
    t = A.audit(spark, d).filter("op_lower = 'send'").select("message_id", F.col("actor").alias("sender"), F.col("ip").alias("recipient"), "sec")
    return J.trace_gap(t, A.messages(spark, d).filter("sender LIKE 'en@%'"), ("user1", "USER2", "user3"), 19725 * 86400)


MESSAGE_TRACE_GAP = f"""WITH {AUDIT_BASE}, {MESSAGES} SELECT replace(replace(message_id, '<', ''), '>', '') AS id, actor AS sender, ip AS recipient, sec FROM v_audit
WHERE op_lower = 'send' AND actor IN ('user1', 'user2', 'user3') AND sec >= {19725 * 86400} AND message_id NOT IN (SELECT message_id FROM v_msg WHERE sender LIKE 'en@%')"""


def recipient_notification(spark, d):
    c = A.correspondence(spark, d)
    internal = c.filter("sender_domain < 'NATION_15'").select(F.col("sender_domain").alias("domain")).distinct()
    return J.notification_scope(c.select("message", F.col("sender").alias("recipient"), F.col("sender_domain").alias("recipient_domain")), internal)


RECIPIENT_NOTIFICATION = f"WITH {CORRESPONDENCE} SELECT sender_domain AS domain, count(DISTINCT sender) AS recipients, count(DISTINCT message) AS messages FROM v_corr WHERE sender_domain >= 'NATION_15' GROUP BY 1"

_ALL = (
    domain_baseline, frequent_senders, internal_domains, dominant_recipient, sender_recipient_pairs, sending_ip_anomaly, familiarity, rule_keyword_policy, block_statistics, boilerplate_blocks, mass_mail_bursts, boilerplate_removal,
    quoted_split, message_event_join, deleted_absent, attacker_authorship, exposure_scope, signin_lure_window, tokens_without_lure, first_lure, rule_replay, attachment_substitution, message_trace_gap, recipient_notification,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
