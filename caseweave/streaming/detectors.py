"""The windowed detectors on streams, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave import config as C


def spray_stream(signins: DataFrame, window: str = "60 minutes", slide: str = "5 minutes", late: str = "10 minutes", least_users: int = 5, key: str = "ip") -> DataFrame:
    """key, start, users, failures of each sliding window in which wrong passwords hit many users. signins: ts, user, key, code.
    Failures are counted for each user first, then users: state is small rows, spread over all tasks by user, that the
    watermark removes; no set of users is held. For the append mode, in which a window comes once, when it is over."""
    bad = signins.filter(F.col("code").isin(*C.BAD_PASSWORD_CODES)).withWatermark("ts", late)
    each = bad.groupBy(F.window("ts", window, slide), key, "user").agg(F.count("*").alias("failures"))
    g = each.groupBy("window", key).agg(F.count("user").alias("users"), F.sum("failures").alias("failures"))
    return g.filter(F.col("users") >= least_users).select(key, F.col("window.start").alias("start"), "users", "failures")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """actor, start, end, events of sessions that a gap of silence ends. events: ts, actor, op_lower."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "actor").agg(F.count("*").alias("events"), F.count_if(F.col("op_lower").isin(*C.DELETE_OPS)).alias("deletes"))
    return g.select("actor", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "deletes")


def lure_stream(lures: DataFrame, tokens: DataFrame, window: str = "20 minutes", late: str = "10 minutes") -> DataFrame:
    """lure, token of messages that came within a window before a token of their user: a join of two streams, each with a
    watermark, so that old rows leave the state. lures: id, user, ts; tokens: id, user, ts."""
    a = lures.select(F.col("id").alias("lure"), "user", F.col("ts").alias("at")).withWatermark("at", late)
    b = tokens.select(F.col("id").alias("token"), F.col("user").alias("u"), F.col("ts").alias("when")).withWatermark("when", late)
    return a.join(b, F.expr(f"user = u AND at <= when AND at >= when - INTERVAL {window}")).select("lure", "token")
