"""The shared tables in the shapes of mail, audit log and sign-in log. Times are microseconds and seconds of UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: event_type of the shared table events, and the audit operation and sign-in code it stands for.
OPERATIONS = {"click": "MailItemsAccessed", "view": "FileDownloaded", "purchase": "Send", "signup": "New-InboxRule", "error": "HardDelete"}
CODES = {"signup": "50074", "error": "50126"}
#: Addresses that the queries take as the attacker's.
ATTACKER_IPS = ("10.0.3.1", "10.0.3.2", "10.0.5.4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, ts.cast("timestamp_ntz"))


def _mapped(col: Column, pairs: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in pairs.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, sec, day, actor, op, op_lower, ip, ip_wide, session_id, k, message_id, client_info."""
    e = table(spark, sf_dir, "events")
    op = _mapped(F.col("event_type"), OPERATIONS, "Other")
    octet = (F.col("user_id") % 7).cast("string")
    client = F.element_at(F.array(*[F.lit(x) for x in ("Client=OWA;Action=ViaProxy", "Client=RESTSystem;", "Client=Outlook Mobile", "")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        "event_id", micros(F.col("ts")).alias("us"), F.expr("cast(user_id as string)").alias("u"), (F.col("event_id") % 11).cast("string").alias("e11"), octet.alias("octet"),
        op.alias("op"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat(F.lit("<m"), (F.col("event_id") % 997).cast("string"), F.lit(">")).alias("message_id"), client.alias("client_info"), "value",
    ).select(
        "event_id", "us", F.expr("us div 1000000").alias("sec"), F.expr("us div 86400000000").alias("day"), F.concat(F.lit("user"), "u").alias("actor"), "op", F.lower("op").alias("op_lower"),
        F.concat(F.lit("10.0."), "octet", F.lit("."), "e11").alias("ip"), F.concat(F.lit("10.0."), "octet").alias("ip_wide"),
        F.concat("u", F.lit("-"), F.expr("us div 86400000000").cast("string")).alias("session_id"), "k", "message_id", "client_info", "value",
    )


def signins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, sec, user, ip, ip_wide, code (empty for success), ok, asn, country, agent, corr, interactive."""
    a = audit(spark, sf_dir)
    kind = {v: k for k, v in OPERATIONS.items()}
    agent = _mapped(F.col("op"), kind, "other")
    code = _mapped(agent, CODES, "")
    return a.select(
        "event_id", "us", "sec", F.col("actor").alias("user"), "ip", "ip_wide", code.alias("code"), (code == "").alias("ok"), (F.col("k") % 9).cast("string").alias("asn"), (F.col("k") % 5).cast("string").alias("country"),
        agent.alias("agent"), F.concat("actor", F.lit("-"), F.expr("sec div 600").cast("string")).alias("corr"), (F.col("event_id") % 2 == 0).alias("interactive"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, body, subject, sender, sender_domain, day (since 1970), message_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("body"), F.substring_index("text", "\n", 1).alias("subject"), F.concat("lang", F.lit("@"), "source").alias("sender"),
        F.concat("source", F.lit(".example")).alias("sender_domain"), (F.lit(19723) + F.col("doc_id") % 180).alias("day"), F.concat(F.lit("<m"), (F.col("doc_id") % 1500).cast("string"), F.lit(">")).alias("message_id"),
    )


def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread, pos, sender, body, message_id, in_reply_to."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), F.col("role").alias("sender"), F.coalesce("text", F.lit("")).alias("body"),
        F.concat("conv_id", F.lit("."), "turn").alias("message_id"), F.when(F.col("turn") > 0, F.concat("conv_id", F.lit("."), F.col("turn") - 1)).alias("in_reply_to"),
    )


def correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message, sender, sender_domain, recipient, day, auth (pass, fail, absent)."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    auth = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").otherwise("absent")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("message"), F.col("c_name").alias("sender"), F.col("n_name").alias("sender_domain"), F.concat(F.lit("clerk"), F.col("o_orderkey") % 50).alias("recipient"),
        F.floor(micros(F.col("o_orderdate")) / F.lit(86400000000)).cast("long").alias("day"), auth.alias("auth"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, thread, name, sha, day."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("path"), F.col("l_orderkey").alias("thread"), F.concat(F.lit("part"), F.col("l_partkey") % 20).alias("name"),
        F.col("l_suppkey").cast("string").alias("sha"), F.floor(micros(F.col("l_shipdate")) / F.lit(86400000000)).cast("long").alias("day"),
    )
