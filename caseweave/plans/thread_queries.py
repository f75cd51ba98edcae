"""Thread and campaign queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave.functions.text import normalize_subject, terms_present, token_set
from caseweave.operators import campaigns as K
from caseweave.operators import graph as G
from caseweave.operators import threads as T
from caseweave.plans.text_queries import _STOPS, _sql_term
from caseweave.plans.views import MESSAGES, THREADS

TERMS = ("license", "worthless", "token", "pathetic")


def _scored(spark, d):
    t = A.thread_messages(spark, d)
    return t.select("thread", "pos", "sender", F.col("message_id").alias("path"), (F.length("body") % 20).alias("score"), F.lower("body").contains("with").alias("login"), F.lower("body").contains("from").alias("pay"), (F.col("thread") * 3 + F.col("pos")).alias("day"))


_SCORED = f"""{THREADS}, s AS (SELECT thread, pos, sender, message_id AS path, length(body) % 20 AS score, contains(lower(body), 'with') AS login, contains(lower(body), 'from') AS pay, thread * 3 + pos AS day FROM v_thread),
p AS (SELECT *, coalesce(max(score) OVER w >= score + 4, false) AS esc, coalesce(login AND bool_or(pay) OVER w, false) AS ltp FROM s WINDOW w AS (PARTITION BY thread ORDER BY pos, path ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def thread_precursor(spark, d):
    return T.precursors(_scored(spark, d))


THREAD_PRECURSOR = f"WITH {_SCORED} SELECT path, thread, score, CASE WHEN esc THEN 5 ELSE 0 END + CASE WHEN ltp THEN 8 ELSE 0 END AS bonus, esc OR ltp AS likely_precursor FROM p"


def thread_earlier_domains(spark, d):
    return T.new_participants(_scored(spark, d))


THREAD_EARLIER_DOMAINS = f"""WITH {_SCORED}, c AS (SELECT a.path, (SELECT count(DISTINCT b.sender) FROM s b WHERE b.thread = a.thread AND b.pos < a.pos) AS seen_before, (SELECT count(*) FROM s b WHERE b.thread = a.thread AND b.pos < a.pos AND b.sender = a.sender) AS own FROM s a)
SELECT path, seen_before, seen_before > 0 AND own = 0 AS new FROM c"""


def thread_roots(spark, d):
    t = A.thread_messages(spark, d)
    return G.thread_roots(t.select(F.col("message_id").alias("id"), F.col("in_reply_to").alias("parent")))


THREAD_ROOTS = f"""WITH RECURSIVE {THREADS}, w AS (SELECT message_id AS id, message_id AS root, 0 AS steps FROM v_thread WHERE in_reply_to IS NULL OR in_reply_to NOT IN (SELECT message_id FROM v_thread)
  UNION ALL SELECT t.message_id, w.root, w.steps + 1 FROM v_thread t JOIN w ON t.in_reply_to = w.id) SELECT * FROM w"""


def earliest_precursor(spark, d):
    return T.earliest_precursor(_scored(spark, d).join(T.precursors(_scored(spark, d)).select("path", "likely_precursor"), "path"))


EARLIEST_PRECURSOR = f"""WITH {_SCORED}, e AS (SELECT path, day, score, esc OR ltp AS likely, max(score) OVER (ORDER BY day, path ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS top FROM p)
SELECT path, day, score, top AS followed_by FROM e WHERE likely AND top >= greatest(10, score - 1) ORDER BY day, path LIMIT 1"""


def _features(spark, d):
    m = A.messages(spark, d)
    empty = F.array().cast("array<string>")
    return m.select("path", "sender", F.col("sender_domain").alias("domain"), "day", normalize_subject(F.col("subject")).alias("subject"), token_set(F.col("subject")).alias("subject_tokens"), terms_present(F.col("body"), TERMS).alias("terms"), *[empty.alias(c) for c in ("urls", "files", "hashes", "recipients")])


def _keys():
    return {"subject": (F.array("subject"), False), "sender": (F.array("sender"), False), "domain": (F.array("domain"), True), "term": (F.col("terms"), True)}


def campaign_pairs(spark, d):
    return K.campaign_links(_features(spark, d), _keys())


_TERMS = "list_filter([" + ", ".join(f"CASE WHEN {_sql_term(t)} THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL)"
_PAIRS = f"""{MESSAGES}, f AS (SELECT path, sender, sender_domain AS domain, day, lower(trim(regexp_replace(regexp_replace(subject, '(?i)^(\\s*(re|fw|fwd)\\s*:\\s*)+', ''), '\\s+', ' ', 'g'))) AS subject,
  list_filter(list_distinct(regexp_extract_all(lower(subject), '[a-z0-9]{{3,}}')), lambda x: x NOT IN {_STOPS}) AS st, {_TERMS} AS terms FROM v_msg),
k AS (SELECT path, 's' || subject AS key, false AS weak FROM f WHERE subject <> '' UNION ALL SELECT path, 'm' || sender, false FROM f UNION ALL SELECT path, 'd' || domain, true FROM f UNION ALL SELECT path, 't' || unnest(terms), true FROM f),
n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY path) AS r FROM k), g AS (SELECT key, path FROM n),
pr AS (SELECT DISTINCT x.path AS a, y.path AS b FROM g x JOIN g y ON x.key = y.key AND x.path < y.path),
j AS (SELECT pr.a, pr.b, fa.sender = fb.sender AS ss, fa.domain = fb.domain AS sd, abs(fa.day - fb.day) AS days, len(list_intersect(fa.terms, fb.terms)) AS st,
  CASE WHEN len(fa.st) = 0 OR len(fb.st) = 0 THEN 0.0 ELSE len(list_intersect(fa.st, fb.st)) / len(list_distinct(list_concat(fa.st, fb.st))) END AS jac FROM pr JOIN f fa ON fa.path = pr.a JOIN f fb ON fb.path = pr.b),
t AS (SELECT a, b, days, CAST(CASE WHEN ss THEN 0.30 ELSE 0 END AS DOUBLE) + CASE WHEN sd THEN 0.12 ELSE 0 END + CASE WHEN jac >= 0.5 THEN 0.25 WHEN jac >= 0.25 THEN 0.12 ELSE 0 END + least(0.25, st * 0.08)
  + CASE WHEN days <= 1 THEN 0.12 WHEN days <= 3 THEN 0.08 WHEN days <= 7 THEN 0.05 ELSE 0 END AS s FROM j),
l AS (SELECT a, b, round(least(1.0, CASE WHEN days > 30 THEN s * 0.5 ELSE s END), 6) AS similarity FROM t WHERE round(least(1.0, CASE WHEN days > 30 THEN s * 0.5 ELSE s END), 6) >= 0.38)"""
CAMPAIGN_PAIRS = f"WITH {_PAIRS} SELECT a, b, similarity FROM l"


def campaign_components(spark, d):
    return K.campaign_members(_features(spark, d), _keys())


_COMPONENTS = f"""{_PAIRS}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
cc AS (SELECT node AS path, min(reach) AS campaign FROM r GROUP BY node)"""
CAMPAIGN_COMPONENTS = f"WITH RECURSIVE {_COMPONENTS} SELECT path, campaign FROM cc"


def campaign_summary(spark, d):
    f = _features(spark, d).select("path", "sender", "domain", "day", (F.col("path") % 17).alias("score"), (F.col("path") % 29 == 0).alias("precursor"), F.array_distinct(F.array((F.col("path") % 3).cast("string"))).alias("urls"))
    return K.campaign_summary(campaign_components(spark, d).join(f, "path"))


CAMPAIGN_SUMMARY = f"""WITH RECURSIVE {_COMPONENTS}, m AS (SELECT cc.campaign, f.*, f.path % 17 AS score, f.path % 29 = 0 AS pre FROM cc JOIN f USING (path)),
gg AS (SELECT campaign, count(*) AS size, min(day) AS first_day, max(day) AS last_day, string_agg(DISTINCT sender, ',' ORDER BY sender) AS senders, count(DISTINCT domain) AS domains, count(DISTINCT path % 3) AS url_domains,
  max(score) AS top, CAST(sum(score) AS BIGINT) AS total, bool_or(pre) AS pre, (SELECT path FROM m x WHERE x.campaign = m.campaign ORDER BY score + CASE WHEN pre THEN 20 ELSE 0 END DESC, day, path LIMIT 1) AS origin FROM m GROUP BY campaign),
ss AS (SELECT *, top + CASE WHEN size > 1 THEN least(10, (total - top) // 3) ELSE 0 END + CASE WHEN size >= 3 THEN 3 ELSE 0 END + CASE WHEN domains >= 2 THEN 3 ELSE 0 END + least(6, url_domains * 2) + CASE WHEN pre THEN 5 ELSE 0 END AS score FROM gg)
SELECT campaign, size, first_day, last_day, senders, domains, url_domains, score, origin, CASE WHEN score >= 35 THEN 'high' WHEN score >= 22 AND size >= 2 THEN 'medium' WHEN size >= 3 AND pre THEN 'medium' ELSE 'low' END AS confidence FROM ss"""

QUERIES = {f.__name__: f for f in (thread_precursor, thread_earlier_domains, thread_roots, earliest_precursor, campaign_pairs, campaign_components, campaign_summary)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
