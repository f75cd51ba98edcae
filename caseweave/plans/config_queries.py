"""Queries over attachments' content, configuration exports and what investigators know, on values made of the shared tables'
own, and their SQL. The SQL states every fixed value by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import adapters as A
from caseweave.functions import files
from caseweave.operators import enrich as E
from caseweave.operators import identity as I
from caseweave.operators import scenario as S
from caseweave.plans.evidence_queries import _case, _pick
from caseweave.plans.views import MESSAGES

_HEADS = ("4D5A90", "255044462D", "504B030414", "D0CF11E0A1B11AE1", "FFD8FFE0", "2320", "20203C48544D4C3E", "2321", "")
_ENDS = (".pdf", ".exe", ".docm", ".jpg", ".txt", ".html", ".7z", ".pdf.js")


def attachment_kinds(spark, d):
    x = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unhex(_pick(_HEADS, F.col("l_orderkey"))).alias("head"), F.concat(F.lit("file"), _pick(_ENDS, F.col("l_partkey"))).alias("name"))
    flags = files.name_flags(F.col("name"), files.sniff(F.col("head")), F.lit(None).cast("array<string>"))
    return x.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), files.sniff(F.col("head")).alias("kind"), F.array_join(flags, ",").alias("flags"))


ATTACHMENT_KINDS = """WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, ['pe_executable', 'pdf', 'zip', 'ole', 'jpeg', '', 'html', 'script', ''][l_orderkey % 9 + 1] AS kind, l_partkey % 8 AS e FROM lineitem),
y AS (SELECT *, ['pdf', 'pe_executable', 'zip', 'jpeg', NULL, NULL, '7z', NULL][e + 1] AS declared FROM x), z AS (SELECT *, kind <> '' AND declared IS NOT NULL AND declared <> kind AS differs, kind IN ('pe_executable', 'elf_executable', 'script') AS runs FROM y)
SELECT l_orderkey, l_linenumber, kind, concat_ws(',', CASE WHEN e = 7 THEN 'double extension' END, CASE WHEN e IN (1, 7) THEN 'executable extension' END, CASE WHEN e = 2 THEN 'macro extension' END, CASE WHEN differs AND runs THEN 'disguised executable' END,
  CASE WHEN differs AND NOT runs THEN 'content does not match the extension' END, CASE WHEN e = 6 THEN 'archive not inspected' END, CASE WHEN e = 5 THEN 'web page' END) AS flags FROM z"""

_FOLDERS = ("", "RSS Feeds", "Archive", "Invoices", "junk")


def _live(spark, d):
    """Inbox rules as an export has them, one for each customer."""
    k = F.col("c_custkey")
    to = F.when(k % 4 == 0, F.concat(F.lit("smtp:Out"), k % 40, F.lit("@Evil.example"))).when(k % 4 == 1, F.lit("in@corp.example"))
    return I.mailbox_rules(A.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat("c_name", F.lit("@corp.example")).alias("mailbox"), to.alias("forward_to"), _pick(_FOLDERS, F.floor(k / 2)).alias("move_to"), _pick(("no", "True", "0"), F.floor(k / 3)).alias("delete"), F.when(k % 3 == 0, F.concat(F.lit("'Wire"), k % 30, F.lit("'; pay"))).alias("words")))


_LIVE = f"""l0 AS (SELECT c_name AS name, c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'out' || (c_custkey % 40) || '@evil.example' WHEN c_custkey % 4 = 1 THEN 'in@corp.example' END AS f, lower({_case(_FOLDERS, 'c_custkey // 2')}) AS move_to,
  c_custkey // 3 % 3 = 1 AS gone, CASE WHEN c_custkey % 3 = 0 THEN 'wire' || (c_custkey % 30) END AS w FROM customer),
v_live AS (SELECT *, gone OR f IS NOT NULL OR move_to = 'rss feeds' OR (move_to IN ('archive', 'junk') AND w IS NOT NULL) AS conceals FROM l0)"""


def mailbox_rules(spark, d):
    return _live(spark, d).select("name", F.array_join("forwards", ",").alias("forwards"), F.array_join("words", ",").alias("words"), "move_to", "conceals")


MAILBOX_RULES = f"WITH {_LIVE} SELECT name, coalesce(f, '') AS forwards, CASE WHEN w IS NULL THEN '' ELSE w || ',pay' END AS words, move_to, conceals FROM v_live"


def rules_unexplained(spark, d):
    s = A.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    log = s.select("s_name", F.array(F.concat(F.lit("out"), k % 20, F.lit("@evil.example"))).alias("forwards"), F.array(F.concat(F.lit("wire"), k % 15)).alias("words"), F.lit("").alias("move_to")).withColumnRenamed("s_name", "name")
    return E.config_drift(_live(spark, d), log, ("corp.example",))


RULES_UNEXPLAINED = f"""WITH {_LIVE}, g AS (SELECT DISTINCT 'out' || (s_suppkey % 20) || '@evil.example' AS f, 'wire' || (s_suppkey % 15) AS w FROM supplier)
SELECT name, coalesce(f, '') LIKE '%@evil.example' AS external FROM v_live v WHERE conceals AND coalesce(f, '') NOT IN (SELECT f FROM g) AND coalesce(w, '') NOT IN (SELECT w FROM g)"""

_RIGHTS = ("FullAccess", "SendAs, ReadPermission", "Owner", "ChangePermission", "SendOnBehalf")
_TRUSTEES = ("Eve@Evil.example", "dan@corp.example", "NT AUTHORITY\\SELF", "Team", "S-1-5-21-7")


def delegations_held(spark, d):
    k = F.col("c_custkey")
    rows = A.table(spark, d, "customer").select(F.col("c_name").alias("mailbox"), _pick(_TRUSTEES, k).alias("user"), _pick(_RIGHTS, F.floor(k / 5)).alias("rights"), _pick(("False", "True", "false"), k).alias("inherited"))
    return E.delegations(I.mailbox_permissions(rows), ("corp.example",))


DELEGATIONS_HELD = """SELECT c_name AS mailbox, ['eve@evil.example', 'dan@corp.example', '', 'team', ''][c_custkey % 5 + 1] AS "user", c_custkey % 5 = 0 AS external FROM customer
WHERE c_custkey % 3 <> 1 AND c_custkey % 5 NOT IN (2, 4) AND c_custkey // 5 % 5 IN (0, 1, 4)"""


def anchors_matched(spark, d):
    m = A.messages(spark, d)
    a = S.Anchors(attacker_addresses=("EN@src1",), attacker_domains=("src4.example",), impersonated=("Tion",), subjects=("the",))
    return m.select("path", F.array_join(S.anchor_matches(m, a), ";").alias("matches"))


ANCHORS_MATCHED = f"""WITH {MESSAGES} SELECT path, concat_ws(';', CASE WHEN lower(sender) = 'en@src1' THEN 'attacker address EN@src1' END, CASE WHEN contains(lower(subject), 'the') THEN 'subject the' END,
  CASE WHEN contains(lower(body), 'tion') THEN 'impersonated party Tion' END, CASE WHEN sender_domain = 'src4.example' THEN 'attacker domain src4.example' END) AS matches FROM v_msg"""


def initiators(spark, d):
    e = A.table(spark, d, "events")
    by = _pick(('{"user": {"userPrincipalName": "A@x", "ipAddress": "10.0.0.1"}}', '{"app": {"displayName": "Sync"}}', "@{user=@{userPrincipalName=c@d; id=1}}", "plain name", ""), F.col("event_id"))
    who = I.initiator(by, F.when(F.col("event_id") % 7 == 0, F.lit("flat@x")), F.lit(""))
    return e.select("event_id", who["actor"].alias("actor"), who["ip"].alias("ip"))


INITIATORS = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'flat@x' ELSE ['A@x', 'Sync', 'c@d', 'plain name', ''][event_id % 5 + 1] END AS actor, CASE WHEN event_id % 5 = 0 THEN '10.0.0.1' ELSE '' END AS ip FROM events"""

_ALL = (attachment_kinds, mailbox_rules, rules_unexplained, delegations_held, anchors_matched, initiators)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
