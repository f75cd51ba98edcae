"""The adapters of caseweave.adapters as DuckDB SQL, for the queries' SQL."""

AUDIT_BASE = """
a0 AS (SELECT event_id, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS u, event_type, value,
  CASE event_type WHEN 'click' THEN 'MailItemsAccessed' WHEN 'view' THEN 'FileDownloaded' WHEN 'purchase' THEN 'Send'
    WHEN 'signup' THEN 'New-InboxRule' WHEN 'error' THEN 'HardDelete' ELSE 'Other' END AS op,
  CAST(event_id % 11 AS VARCHAR) AS e11, CAST(user_id % 7 AS VARCHAR) AS octet,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
v_audit AS (SELECT event_id, us, us // 1000000 AS sec, us // 86400000000 AS day, 'user' || u AS actor, op, lower(op) AS op_lower,
  '10.0.' || octet || '.' || e11 AS ip, '10.0.' || octet AS ip_wide, u || '-' || CAST(us // 86400000000 AS VARCHAR) AS session_id, k,
  '<m' || CAST(event_id % 997 AS VARCHAR) || '>' AS message_id,
  CASE event_id % 4 WHEN 0 THEN 'Client=OWA;Action=ViaProxy' WHEN 1 THEN 'Client=RESTSystem;' WHEN 2 THEN 'Client=Outlook Mobile' ELSE '' END AS client_info,
  value, event_type FROM a0)"""
SIGNINS = (
    AUDIT_BASE
    + """,
v_signin AS (SELECT event_id, us, sec, actor AS "user", ip, ip_wide,
  CASE event_type WHEN 'signup' THEN '50074' WHEN 'error' THEN '50126' ELSE '' END AS code,
  event_type NOT IN ('signup', 'error') AS ok, CAST(k % 9 AS VARCHAR) AS asn, CAST(k % 5 AS VARCHAR) AS country, event_type AS agent,
  actor || '-' || CAST(sec // 600 AS VARCHAR) AS corr, event_id % 2 = 0 AS interactive FROM v_audit)"""
)
MESSAGES = """
v_msg AS (SELECT doc_id AS path, coalesce(text, '') AS body, split_part(text, chr(10), 1) AS subject, lang || '@' || source AS sender,
  source || '.example' AS sender_domain, 19723 + doc_id % 180 AS day, '<m' || CAST(doc_id % 1500 AS VARCHAR) || '>' AS message_id FROM documents)"""
THREADS = """
v_thread AS (SELECT conv_id AS thread, turn AS pos, role AS sender, coalesce(text, '') AS body, conv_id || '.' || turn AS message_id,
  CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) END AS in_reply_to FROM conversations)"""
CORRESPONDENCE = """
v_corr AS (SELECT o_orderkey AS message, c_name AS sender, n_name AS sender_domain, 'clerk' || (o_orderkey % 50) AS recipient,
  CAST(floor(epoch_us(o_orderdate) / 86400000000.0) AS BIGINT) AS day,
  CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'absent' END AS auth
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
ATTACHMENTS = """
v_att AS (SELECT l_orderkey || '-' || l_linenumber AS path, l_orderkey AS thread, 'part' || (l_partkey % 20) AS name,
  CAST(l_suppkey AS VARCHAR) AS sha, CAST(floor(epoch_us(l_shipdate) / 86400000000.0) AS BIGINT) AS day FROM lineitem)"""
ATTACKERS = "('10.0.3.1', '10.0.3.2', '10.0.5.4')"


def text(values: tuple[str, ...]) -> str:
    """A SQL list of strings."""
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
