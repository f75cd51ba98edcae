"""Scoring and rollup queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave.functions import address
from caseweave.operators import rollups as R
from caseweave.operators import scoring as S
from caseweave.plans.views import ATTACHMENTS, AUDIT_BASE, CORRESPONDENCE, MESSAGES

_WORDS = {"license": ("License named", "language", "body", 4), "token": ("Token in text", "url", "corpus:thread", 6), "worthless": ("Macro word", "attachment", "attachment", 2), "@": ("Address in text", "identity", "audit:x", 1), "queeux": ("Rare word", "auth", "investigator_anchor", 12)}


def _messages(spark, d):
    m = A.messages(spark, d)
    low = F.lower("body")
    rules = [(s, c, src, low.contains(w), n) for w, (s, c, src, n) in _WORDS.items()]
    return m, S.findings(m, rules)


_F = f"""{MESSAGES}, f AS ({" UNION ALL ".join(f"SELECT path, {i} AS seq, '{s}' AS signal, '{c}' AS category, '{src}' AS source, {n} AS weight FROM v_msg WHERE contains(lower(body), '{w}')" for i, (w, (s, c, src, n)) in enumerate(_WORDS.items()))}),
sc AS (SELECT path, coalesce((SELECT sum(weight) FROM f WHERE f.path = m.path), 0) AS score, day, sender, sender_domain, body FROM v_msg m),
tr AS (SELECT path, CASE WHEN score >= 6 THEN 1 WHEN score > 0 THEN 2 ELSE 3 END AS tier FROM sc)"""


def findings(spark, d):
    return _messages(spark, d)[1]


FINDINGS = f"""WITH {_F} SELECT path, 'base' AS stage, seq, signal, category, source, weight, CASE WHEN weight >= 6 THEN 'high' WHEN weight >= 3 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN source = 'investigator_anchor' THEN 'assumed' WHEN source LIKE 'corpus:thread%' OR source LIKE 'audit%' THEN 'observed' ELSE 'inferred' END AS provenance FROM f"""


def priority_scores(spark, d):
    return S.scores(*_messages(spark, d))


PRIORITY_SCORES = f"WITH {_F} SELECT path, CAST(score AS BIGINT) AS score FROM sc"


def _tiers(spark, d):
    s = priority_scores(spark, d)
    return s.select("path", F.when(F.col("score") >= 6, 1).when(F.col("score") > 0, 2).otherwise(3).alias("tier"))


def signal_statistics(spark, d):
    return S.signal_statistics(findings(spark, d), _tiers(spark, d))


SIGNAL_STATISTICS = f"""WITH {_F}, n AS (SELECT count(*) AS n, count(*) FILTER (tier = 1) AS n1 FROM tr)
SELECT signal, count(*) AS fires, count(DISTINCT path) AS messages, count(DISTINCT path) / any_value(n) AS share, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT path) FILTER (tier = 1) AS tier1,
  round(CASE WHEN any_value(n1) > 0 THEN (count(DISTINCT path) FILTER (tier = 1) / count(DISTINCT path)) / (any_value(n1) / any_value(n)) END, 6) AS lift FROM f JOIN tr USING (path), n GROUP BY signal"""


def technique_summary(spark, d):
    return S.technique_summary(findings(spark, d))


TECHNIQUE_SUMMARY = f"""WITH {_F}, t AS (SELECT DISTINCT path, CASE category WHEN 'language' THEN 'T1566' WHEN 'url' THEN 'T1566.002' WHEN 'attachment' THEN 'T1566.001' ELSE 'T1656' END AS technique FROM f
  UNION SELECT path, 'T1204.002' FROM f WHERE contains(lower(signal), 'macro')) SELECT technique, count(*) AS messages FROM t GROUP BY technique"""


def score_modifiers(spark, d):
    c = A.correspondence(spark, d)
    g = c.groupBy("sender").agg(F.count("*").alias("n"), F.count_if(F.col("auth") != "absent").alias("auth_seen"), F.count_if(F.col("auth") == "pass").alias("auth_pass"))
    state = F.when(F.col("auth") == "pass", "aligned").when(F.col("auth") == "fail", "failed").otherwise("absent")
    m = c.select(F.col("message").alias("path"), "sender", (F.col("message") % 23).alias("score"), state.alias("state"))
    return S.baseline_modifiers(m.join(g.withColumn("n", F.when(F.col("n") > 8, F.col("n")).otherwise(F.col("n") % 3)), "sender")).select("path", "score", "delta", "final")


SCORE_MODIFIERS = f"""WITH {CORRESPONDENCE}, g AS (SELECT sender, CASE WHEN count(*) > 8 THEN count(*) ELSE count(*) % 3 END AS n, count(*) FILTER (auth <> 'absent') AS seen, count(*) FILTER (auth = 'pass') AS pass FROM v_corr GROUP BY sender),
m AS (SELECT message AS path, message % 23 AS score, auth, g.* FROM v_corr JOIN g USING (sender)),
x AS (SELECT path, score, CASE WHEN score <= 0 THEN 0 WHEN auth = 'pass' AND n >= 5 THEN -least(score // 2, 8) ELSE CASE WHEN auth = 'fail' THEN CASE WHEN seen >= 3 AND pass / seen >= 0.5 THEN 6 ELSE 5 END ELSE 0 END
  + CASE WHEN n < 2 THEN least(greatest(1, score // 3), 6) WHEN n >= 5 AND auth <> 'fail' THEN -least(score // 4, 4) ELSE 0 END END AS delta FROM m)
SELECT path, score, CAST(delta AS BIGINT) AS delta, CASE WHEN score <= 0 THEN score ELSE greatest(0, score + delta) END AS final FROM x"""


def _screen(spark, d):
    m = A.messages(spark, d)
    low, p = F.lower("body"), F.col("path")
    return S.candidate_screen(m.select("path", (low.contains("license").cast("int") + low.contains("token").cast("int")).alias("high"), low.contains("worthless").cast("int").alias("social"), (p % 3).alias("urls"), (p % 2).alias("url_risk"), (p % 4).alias("files"), F.when(p % 40 == 0, 1).otherwise(0).alias("risky"), (p % 5).alias("auth_fails"), (p % 50 == 0).alias("base64"), (p % 7 == 0).alias("bulk"), F.length("body").alias("chars")))


_SCREEN = f"""{MESSAGES}, q AS (SELECT path, CAST(contains(lower(body), 'license') AS INT) + CAST(contains(lower(body), 'token') AS INT) AS high, contains(lower(body), 'worthless') AS social, path % 3 AS urls, path % 2 AS ur, path % 4 AS files, path % 40 = 0 AS risky, path % 5 AS fails, path % 50 = 0 AS b64, path % 7 = 0 AS bulk, length(body) AS chars FROM v_msg),
r AS (SELECT *, [b64, high >= 2, high = 1, social AND (high > 0 OR urls > 0), risky, urls > 0 AND ur > 0 AND (high > 0 OR social), files > 0 AND NOT risky AND (high > 0 OR social), chars > 12000 AND high > 0] AS c FROM q),
b AS (SELECT *, list_sum(list_transform([3, 5, 2, 3, 5, 2, 1, 1], lambda w, i: CASE WHEN c[i] THEN w ELSE 0 END)) AS base FROM r),
s AS (SELECT *, fails > 0 AND bulk AND base = 0 AS excused FROM b), t AS (SELECT *, base + least(4, CASE WHEN excused THEN 0 ELSE fails END * 2) AS score FROM s),
scr AS (SELECT path, CAST(score AS BIGINT) AS score, score >= 5 OR (score >= 4 AND (high > 0 OR social OR risky OR (fails > 0 AND NOT excused))) OR (high > 0 AND social) AS candidate, list_concat(list_filter(list_transform(['base64-encoded content in body', 'multiple high-signal terms', 'high-signal term', 'social-engineering combination', 'risky attachment type', 'suspicious URL context', 'attachment with suspicious context', 'large transactional body'], lambda x, i: CASE WHEN c[i] THEN x END), lambda x: x IS NOT NULL),
  CASE WHEN excused THEN ['authentication anomaly on bulk mail - not promoted'] WHEN fails > 0 THEN ['authentication anomaly'] ELSE [] END) AS reasons FROM t)"""


def candidate_screen(spark, d):
    return _screen(spark, d).select("path", "score", "candidate", F.array_join("reasons", "; ").alias("reasons"))


CANDIDATE_SCREEN = f"WITH {_SCREEN} SELECT path, score, candidate, array_to_string(reasons, '; ') AS reasons FROM scr"


def candidate_reasons(spark, d):
    return S.candidate_reasons(_screen(spark, d))


CANDIDATE_REASONS = f"WITH {_SCREEN} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM scr WHERE candidate) GROUP BY reason"


def attack_stages(spark, d):
    m = A.messages(spark, d)
    text = F.concat("body", F.element_at(F.array(*[F.lit(x) for x in ("", " wire me", " see attached", " the Password", " urgent")]), (F.col("path") % 5 + 1).cast("int")))
    return m.select("path", S.attack_stage(text, F.col("path") % 2 == 0, F.col("path") % 3 == 0).alias("stage"))


def _any(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


ATTACK_STAGES = f"""WITH {MESSAGES}, x AS (SELECT path, lower(body || ['', ' wire me', ' see attached', ' the Password', ' urgent'][path % 5 + 1]) AS t FROM v_msg)
SELECT path, CASE WHEN {_any(S.STAGES[0][2])} THEN 'payment_request' WHEN path % 2 = 0 AND {_any(S.STAGES[1][2])} THEN 'attachment_delivery' WHEN path % 3 = 0 AND {_any(S.STAGES[2][2])} THEN 'credential_harvest'
  WHEN {_any(S.STAGES[3][2])} THEN 'social_engineering' WHEN path % 3 = 0 THEN 'suspicious_link' ELSE 'initial_contact' END AS stage FROM x"""


def _flagged(spark, d):
    m = A.messages(spark, d)
    p = F.col("path")
    flags = {"inbound": p % 4 != 0, "anchored": p % 61 == 0, "in_window": F.col("day").between(19750, 19800), "relevant": F.col("day") > 19750, "attacker_sent": p % 97 == 0, "substituted": p % 101 == 0, "confirmed": p % 103 == 0, "attacker_read": p % 13 == 0, "signin_confirmed": p % 107 == 0}
    return m.withColumns({**flags, "scenario_score": p % 19})


_FLAGS = f"""{MESSAGES}, z AS (SELECT *, path % 4 <> 0 AS inbound, path % 61 = 0 AS anchored, day BETWEEN 19750 AND 19800 AS in_window, day > 19750 AS relevant, path % 19 AS ss FROM v_msg),
tt AS (SELECT *, CASE WHEN path % 97 = 0 OR path % 101 = 0 OR path % 103 = 0 THEN 1 WHEN inbound AND anchored THEN 1 WHEN inbound AND in_window AND ss >= 12 THEN 1 WHEN inbound AND (relevant OR anchored) AND ss > 0 THEN 2 ELSE 3 END AS t0 FROM z),
tier AS (SELECT *, CASE WHEN path % 107 = 0 THEN 1 WHEN path % 13 = 0 THEN least(t0, 2) ELSE t0 END AS tier FROM tt)"""


def message_tiers(spark, d):
    return S.tiers(_flagged(spark, d))


MESSAGE_TIERS = f"WITH {_FLAGS} SELECT path, tier FROM tier"


def tiering(spark, d):
    return S.tiers(_flagged(spark, d)).groupBy("tier").agg(F.count("*").alias("n"))


TIERING = f"WITH {_FLAGS} SELECT tier, count(*) AS n FROM tier GROUP BY tier"


def initial_verdict(spark, d):
    return S.initial_verdict(_flagged(spark, d), True)


INITIAL_VERDICT = f"""WITH {_FLAGS} SELECT (SELECT count(*) FROM z WHERE ss > 0 AND in_window) AS pool, path, day, ss AS scenario_score, anchored, CASE WHEN anchored AND ss >= 16 THEN 'high' WHEN ss >= 12 THEN 'medium' ELSE 'low' END AS confidence
FROM z WHERE ss > 0 AND in_window ORDER BY ss >= 12 DESC, CASE WHEN ss >= 12 THEN day ELSE -ss END, CASE WHEN ss >= 12 THEN -ss ELSE day END, path LIMIT 1"""


def shortlist(spark, d):
    return S.shortlist(_flagged(spark, d))


SHORTLIST = f"WITH {_FLAGS} SELECT row_number() OVER (ORDER BY ss DESC, day, path) AS rank, path, ss AS scenario_score FROM z WHERE ss > 0 ORDER BY ss DESC, day, path LIMIT 10"


def _tiered(spark, d):
    return A.messages(spark, d).join(_tiers(spark, d), "path").join(priority_scores(spark, d), "path")


def ioc_rollup(spark, d):
    m = _tiered(spark, d)
    base = ["path", "day", "tier", "score"]
    ctx = F.lit("").alias("context")
    kinds = [
        m.select(F.lit("sender").alias("type"), F.col("sender").alias("value"), ctx, *base), m.select(F.lit("sender_domain").alias("type"), F.col("sender_domain").alias("value"), ctx, *base),
        m.select(F.lit("email").alias("type"), F.explode(address.addresses(F.col("body"))).alias("value"), F.lit("text").alias("context"), *base), m.select(F.lit("ip").alias("type"), F.explode(address.ipv4s(F.col("body"))).alias("value"), ctx, *base),
    ]
    return R.ioc_rollup(R.union_all(kinds))


IOC_ROLLUP = f"""WITH {_F}, m AS (SELECT sc.*, tier FROM sc JOIN tr USING (path)), i AS (SELECT 'sender' AS type, sender AS value, '' AS context, path, day, tier, score FROM m UNION ALL SELECT 'sender_domain', sender_domain, '', path, day, tier, score FROM m
  UNION ALL SELECT 'email', unnest(list_distinct(list_transform(regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), lambda x: lower(x)))), 'text', path, day, tier, score FROM m
  UNION ALL SELECT 'ip', unnest(list_filter(list_distinct(regexp_extract_all(body, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')), lambda ip: len(list_filter(string_split(ip, '.'), lambda x: CAST(x AS INT) > 255)) = 0)), '', path, day, tier, score FROM m),
j AS (SELECT * REPLACE (lower(value) AS value), dense_rank() OVER (PARTITION BY type, lower(value) ORDER BY path) AS r FROM i WHERE tier <= 2)
SELECT type, value, count(*) AS occurrences, min(day) AS first_day, max(day) AS last_day, min(tier) AS best_tier, CAST(max(score) AS BIGINT) AS max_score, max(context) AS context, string_agg(CASE WHEN r <= 3 THEN CAST(path AS VARCHAR) END, '|' ORDER BY path) AS examples FROM j GROUP BY type, value"""


def top_domains(spark, d):
    return R.top_domains(_tiered(spark, d))


TOP_DOMAINS = f"""WITH {_F} SELECT sender_domain AS domain, count(*) AS messages, min(tier) AS highest_tier, CAST(sum(score) AS BIGINT) AS total_score, count(DISTINCT sender) AS senders FROM sc JOIN tr USING (path) WHERE tier IN (1, 2)
GROUP BY 1 ORDER BY highest_tier, total_score DESC, domain LIMIT 15"""


def score_histogram(spark, d):
    return R.histogram(A.table(spark, d, "events"), "value")


_EDGES = (0, 1, 5, 10, 15, 20, 30, 40, 60, 100)
SCORE_HISTOGRAM = "SELECT CASE " + " ".join(f"WHEN value >= {a} AND value < {b} THEN '{a}-{b - 1}'" for a, b in zip(_EDGES, _EDGES[1:])) + " ELSE '>=100' END AS bucket, count(*) AS n FROM events GROUP BY 1"


def score_quantiles(spark, d):
    return R.quantiles(A.table(spark, d, "events"), "value")


SCORE_QUANTILES = """WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM events)
SELECT v[1] AS min, v[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1] AS p50, v[CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1] AS p90, v[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS p99, v[n] AS max, round(m, 2) AS mean FROM s"""


def entity_graph(spark, d):
    c = A.correspondence(spark, d)
    return R.entity_graph(c.select("sender", F.col("sender_domain").alias("other"), F.lit("sender-domain").alias("type")).unionByName(c.select("sender", F.col("recipient").alias("other"), F.lit("recipient").alias("type"))))


ENTITY_GRAPH = f"""WITH {CORRESPONDENCE}, e AS (SELECT sender, sender_domain AS other, 'sender-domain' AS type FROM v_corr UNION ALL SELECT sender, recipient, 'recipient' FROM v_corr),
n AS (SELECT a, count(*) AS n FROM (SELECT sender AS a FROM e UNION ALL SELECT other FROM e) GROUP BY a ORDER BY n DESC, a LIMIT 150)
SELECT 'node' AS kind, a, '' AS b, n FROM n UNION ALL SELECT type, least(sender, other), greatest(sender, other), count(*) FROM e WHERE sender IN (SELECT a FROM n) AND other IN (SELECT a FROM n) GROUP BY 1, 2, 3"""


def evidence_chain(spark, d):
    a = A.attachments(spark, d)
    return R.evidence_chain(a.select(F.lit("attachment").alias("relation"), F.concat_ws("/", "sha", "name").alias("indicator"), "path"))


EVIDENCE_CHAIN = f"""WITH {ATTACHMENTS}, s AS (SELECT DISTINCT sha || '/' || name AS indicator, path FROM v_att), l AS (SELECT *, lead(path) OVER (PARTITION BY indicator ORDER BY path) AS target FROM s)
SELECT 'attachment' AS relation, indicator, path AS source, target FROM l WHERE target IS NOT NULL"""


def pivot_indexes(spark, d):
    return R.pivot_index(A.attachments(spark, d), "sha")


PIVOT_INDEXES = f"WITH {ATTACHMENTS} SELECT sha AS key, count(DISTINCT path) AS n, bit_xor(CAST('0x' || substr(md5(path), 1, 15) AS BIGINT)) AS digest FROM (SELECT DISTINCT sha, path FROM v_att) GROUP BY sha"


def corpus_fingerprint(spark, d):
    return R.corpus_fingerprint(A.table(spark, d, "documents"), "doc_id", "text")


CORPUS_FINGERPRINT = """WITH l AS (SELECT substr(md5(CAST(doc_id AS VARCHAR)), 1, 5) AS part, doc_id || ':' || sha256(coalesce(text, '')) AS line FROM documents), p AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS d, count(*) AS n FROM l GROUP BY part)
SELECT CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(d, chr(10) ORDER BY part)) AS fingerprint FROM p"""


def timeline(spark, d):
    a = A.audit(spark, d).select("sec", F.lit("audit").alias("source"), F.col("op").alias("what"), F.col("event_id").cast("string").alias("ref"))
    m = A.messages(spark, d).select((F.col("day") * 86400).alias("sec"), F.lit("message").alias("source"), F.col("sender").alias("what"), F.col("path").cast("string").alias("ref"))
    return R.timeline([a, m])


TIMELINE = f"""WITH {AUDIT_BASE}, {MESSAGES} SELECT sec, 'audit' AS source, op AS what, CAST(event_id AS VARCHAR) AS ref FROM v_audit UNION ALL SELECT day * 86400, 'message', sender, CAST(path AS VARCHAR) FROM v_msg"""

_ALL = (findings, priority_scores, signal_statistics, technique_summary, score_modifiers, candidate_screen, candidate_reasons, attack_stages, message_tiers, tiering, initial_verdict, shortlist, ioc_rollup, top_domains, score_histogram, score_quantiles, entity_graph, evidence_chain, pivot_indexes, corpus_fingerprint, timeline)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
