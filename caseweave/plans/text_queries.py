"""Text, address, URL and HTML queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave import config as C
from caseweave.functions import address, html, text, url
from caseweave.operators import baseline
from caseweave.plans.views import MESSAGES, text as sql_list

#: Words that the shared documents hold, in place of the lexicon of lures.
LEXICON = ("the and", "license", "worthless", "of the", "die und", "la de", "token")


def _sql_term(p: str) -> str:
    return f"regexp_matches(lower(body), '{text.term_pattern(p)}')".replace("\\s", "\\s")


def term_hits_exploded(spark, d):
    return A.messages(spark, d).select("path", F.explode(text.terms_present(F.col("body"), LEXICON)).alias("term"))


TERM_HITS_EXPLODED = f"WITH {MESSAGES} " + " UNION ALL ".join(f"SELECT path, '{p}' AS term FROM v_msg WHERE {_sql_term(p)}" for p in LEXICON)


def term_document_frequency(spark, d):
    hits = baseline.term_frequencies(A.messages(spark, d), F.col("body"), LEXICON).filter("hits > 0")
    share = F.col("hits") / F.col("n")
    return hits.select("term", "hits", share.alias("share"), F.when(share > C.DEFAULTS.phrase_cap, C.DEFAULTS.phrase_cap / share).otherwise(1.0).alias("scale"))


TERM_DOCUMENT_FREQUENCY = f"""WITH {MESSAGES}, h AS ({" UNION ALL ".join(f"SELECT '{p}' AS term, count(*) AS hits FROM v_msg WHERE {_sql_term(p)}" for p in LEXICON)}),
s AS (SELECT term, hits, hits / (SELECT count(*) FROM v_msg) AS share FROM h WHERE hits > 0) SELECT term, hits, share, CASE WHEN share > 0.05 THEN 0.05 / share ELSE 1.0 END AS scale FROM s"""


def token_sets(spark, d):
    t = A.messages(spark, d).withColumn("tokens", text.token_set(F.col("body")))
    return t.select("path", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("digest"))


_STOPS = "('the', 'and', 'for', 'this', 'that', 'with', 'from', 'your', 'you', 'are', 'was', 'has', 'have', 'will', 'can', 'please', 'hello', 'thanks', 'thank', 'regards')"
TOKEN_SETS = f"""WITH {MESSAGES}, t AS (SELECT path, list_sort(list_filter(list_distinct(regexp_extract_all(lower(body), '[a-z0-9]{{3,}}')), lambda x: x NOT IN {_STOPS})) AS w FROM v_msg)
SELECT path, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM t"""


def entropy_tokens(spark, d):
    c = A.table(spark, d, "customer").withColumn("local", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.col("c_mktsegment")))
    return c.select("c_custkey", F.round(text.entropy(F.col("local")), 6).alias("entropy"), address.looks_random(F.col("local")).alias("random_local"))


ENTROPY_TOKENS = """WITH c AS (SELECT c_custkey, lower(replace(c_name, '#', '')) || c_mktsegment AS s FROM customer), x AS (SELECT c_custkey, s, unnest(string_split(s, '')) AS ch FROM c),
n AS (SELECT c_custkey, s, ch, count(*) AS k FROM x GROUP BY ALL), e AS (SELECT c_custkey, s, -sum(k / length(s) * log2(k / length(s))) AS h FROM n GROUP BY c_custkey, s)
SELECT c_custkey, round(h, 6) AS entropy, length(s) >= 12 AND length(regexp_replace(s, '[^0-9]', '', 'g')) >= length(s) * 0.2 AND h >= 3.5 AS random_local FROM e"""


def homoglyph_canon(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", text.homoglyph_canon(F.col("s_name")).alias("canon"))


HOMOGLYPH_CANON = "SELECT s_suppkey, replace(replace(translate(lower(s_name), '01345678$@', 'oleasgtbsa'), 'rn', 'm'), 'vv', 'w') AS canon FROM supplier"


def lookalike_names(spark, d):
    n = A.table(spark, d, "nation").select(F.lower("n_name").alias("name")).distinct()
    return baseline.lookalikes(n, n).filter("name < like_name")


LOOKALIKE_NAMES = """WITH n AS (SELECT DISTINCT lower(n_name) AS name, replace(replace(translate(lower(n_name), '01345678$@', 'oleasgtbsa'), 'rn', 'm'), 'vv', 'w') AS canon FROM nation)
SELECT a.name, b.name AS like_name FROM n a JOIN n b ON a.name < b.name AND length(a.name) >= 5 AND (a.canon = b.canon OR (levenshtein(a.name, b.name) = 1 AND abs(length(a.name) - length(b.name)) <= 1))"""

_SPLIT = url.SPLIT
_PARTS = f"""u0 AS (SELECT page_id, CASE WHEN lower(url) LIKE 'www.%' THEN 'http://' || url ELSE url END AS u, html FROM pages),
u1 AS (SELECT *, lower(regexp_extract(u, '{_SPLIT}', 1)) AS scheme, regexp_extract(u, '{_SPLIT}', 2) AS authority, regexp_extract(u, '{_SPLIT}', 3) AS path, regexp_extract(u, '{_SPLIT}', 4) AS query FROM u0),
u2 AS (SELECT *, lower(regexp_replace(regexp_replace(split_part(authority, '@', -1), ':[0-9]*$', ''), '\\.+$', '')) AS host,
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: lower(split_part(x, '=', 1))) AS params, list_filter(string_split(query, '&'), lambda x: x <> '') AS pairs FROM u1)"""


def registrable_domain(spark, d):
    return A.table(spark, d, "pages").select("page_id", url.parts(F.col("url"))["host"].alias("host"), url.registrable(F.col("url")).alias("domain"))


REGISTRABLE_DOMAIN = f"""WITH {_PARTS}, l AS (SELECT page_id, host, list_filter(string_split(host, '.'), lambda x: x <> '') AS w FROM u2)
SELECT page_id, host, CASE WHEN len(w) = 0 THEN '' WHEN len(w) >= 3 AND array_to_string(w[-2:], '.') IN {sql_list(C.TWO_LABEL_SUFFIXES)} THEN array_to_string(w[-3:], '.') ELSE array_to_string(w[-2:], '.') END AS domain FROM l"""


def url_risk(spark, d):
    u = F.col("url")
    rules = url.risk_rules(u)
    return A.table(spark, d, "pages").select("page_id", *[c.alias(f"r_{n}") for n, (c, _) in rules.items()], url.risk_score(u).cast("long").alias("risk"))


_RULES = {
    "scheme": ("scheme NOT IN ('http', 'https')", 5), "http": ("scheme = 'http'", 2), "userinfo": ("contains(authority, '@')", 6), "ip": ("regexp_full_match(host, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') OR contains(host, ':')", 6),
    "punycode": ("host LIKE 'xn--%' OR contains(host, '.xn--')", 3), "shortener": (f"host IN {sql_list(C.SHORTENERS)}", 3), "tld": (" OR ".join(f"host LIKE '%{t}'" for t in C.RISKY_TLDS), 2),
    "long_host": ("length(host) > 60", 2), "nested": ("length(host) - length(replace(host, '.', '')) >= 4", 2), "at": ("contains(authority, '@')", 4), "redirect": (f"len(list_filter(params, lambda x: x IN {sql_list(C.RISK_PARAMETERS)})) > 0", 3),
    "auth_path": (" OR ".join(f"contains(lower(path), '{t}')" for t in C.AUTH_PATHS), 2), "long": ("length(u) > 180", 2),
}
URL_RISK = f"""WITH {_PARTS}, r AS (SELECT page_id, {', '.join(f'({c}) AS r_{n}' for n, (c, _) in _RULES.items())} FROM u2)
SELECT *, {' + '.join(f'CASE WHEN r_{n} THEN {w} ELSE 0 END' for n, (_, w) in _RULES.items())} AS risk FROM r"""


def url_suspicion(spark, d):
    return A.table(spark, d, "pages").select("page_id", url.suspicion_score(F.col("url")).cast("long").alias("suspicion"))


URL_SUSPICION = f"""WITH {_PARTS} SELECT page_id, CASE WHEN {_RULES['ip'][0]} THEN 20 ELSE 0 END + CASE WHEN contains(authority, '@') THEN 25 ELSE 0 END + CASE WHEN {_RULES['punycode'][0]} THEN 15 ELSE 0 END
  + CASE WHEN host IN {sql_list(C.SUSPICION_SHORTENERS)} THEN 12 ELSE 0 END + CASE WHEN scheme NOT IN ('http', 'https') THEN 15 WHEN scheme = 'http' THEN 8 ELSE 0 END
  + 10 * len(list_filter(params, lambda x: x IN {sql_list(C.REDIRECT_PARAMETERS)})) + 5 * len(list_filter(pairs, lambda x: contains(regexp_extract(x, '=(.*)', 1), '@') OR contains(lower(regexp_extract(x, '=(.*)', 1)), '%40')))
  + CASE WHEN length(host) > 80 THEN 8 ELSE 0 END + CASE WHEN length(path) > 120 THEN 5 ELSE 0 END AS suspicion FROM u2"""


def url_params(spark, d):
    p = A.table(spark, d, "pages").select("page_id", F.explode(url.parameters(url.parts(F.col("url"))["query"])).alias("name"))
    return p.withColumn("redirect", F.col("name").isin(*C.REDIRECT_PARAMETERS))


URL_PARAMS = f"WITH {_PARTS}, n AS (SELECT page_id, unnest(params) AS name FROM u2) SELECT page_id, name, name IN {sql_list(C.REDIRECT_PARAMETERS)} AS redirect FROM n"


def html_links(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link.href")


HTML_LINKS = r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h FROM pages)
SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM l"""


def html_text_length(spark, d):
    t = html.html_to_text(F.col("html"))
    return A.table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


HTML_TEXT_LENGTH = r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM t"""


def html_login_forms(spark, d):
    return A.table(spark, d, "pages").select("page_id", html.has_login_form(F.col("html")).alias("login_form"))


HTML_LOGIN_FORMS = """SELECT page_id, contains(lower(html), '<form') OR regexp_matches(lower(html), '<input[^>]*type\\s*=\\s*["'']?password') AS login_form FROM pages"""


def ip_literals_in_text(spark, d):
    return A.messages(spark, d).select("path", F.explode(address.ipv4s(F.col("body"))).alias("ip")).withColumn("public", address.is_public_ipv4(F.col("ip")))


IP_LITERALS_IN_TEXT = f"""WITH {MESSAGES}, i AS (SELECT path, unnest(list_distinct(regexp_extract_all(body, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}'))) AS ip FROM v_msg),
p AS (SELECT *, list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)) AS o FROM i)
SELECT path, ip, NOT (o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168)) AS public
FROM p WHERE len(list_filter(o, lambda x: x > 255)) = 0"""


def emails_in_text(spark, d):
    e = A.messages(spark, d).select("path", F.explode(address.addresses(F.col("body"))).alias("address"))
    return e.withColumn("domain", address.domain_of(F.col("address"))).withColumn("registrable", address.registrable_domain(F.col("domain")))


EMAILS_IN_TEXT = f"""WITH {MESSAGES}, e AS (SELECT path, unnest(list_distinct(list_transform(regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), lambda x: lower(x)))) AS address FROM v_msg)
SELECT path, address, split_part(address, '@', -1) AS domain, array_to_string(string_split(split_part(address, '@', -1), '.')[-2:], '.') AS registrable FROM e"""


def defang_text(spark, d):
    t = text.defang(F.concat_ws(" ", "subject", F.lit("http://a.b/c me@x.y")))
    return A.messages(spark, d).select("path", F.md5(t).alias("digest"))


DEFANG_TEXT = f"""WITH {MESSAGES} SELECT path, md5(replace(regexp_replace(regexp_replace(subject || ' http://a.b/c me@x.y', '(?i)http', 'hxxp', 'g'), '([A-Za-z0-9])\\.([A-Za-z0-9])', '\\1[.]\\2', 'g'), '@', '[@]')) AS digest FROM v_msg"""


def signal_template(spark, d):
    return A.messages(spark, d).select(text.template(F.col("body")).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


# SIGNAL_TEMPLATE: the patterns look around, which DuckDB's can't; tests compare with Python's.
QUERIES = {f.__name__: f for f in (term_hits_exploded, term_document_frequency, token_sets, entropy_tokens, homoglyph_canon, lookalike_names, registrable_domain, url_risk, url_suspicion, url_params, html_links, html_text_length, html_login_forms, ip_literals_in_text, emails_in_text, defang_text, signal_template)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
