"""What happens within a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def precursors(messages: DataFrame, order: str = "pos") -> DataFrame:
    """path, bonus: +5 where a later message of the thread scores at least 4 more, +8 where login language comes before
    payment language. messages: thread, path, score, login, pay. Only original scores of later rows count, so two
    windows say it all."""
    later = Window.partitionBy("thread").orderBy(F.asc_nulls_last(order), "path").rowsBetween(1, Window.unboundedFollowing)
    m = messages.withColumns({"later_score": F.max("score").over(later), "later_pay": F.bool_or("pay").over(later)})
    escalates = F.coalesce(F.col("later_score") >= F.col("score") + 4, F.lit(False))
    login_then_pay = F.coalesce(F.col("login") & F.col("later_pay"), F.lit(False))
    bonus = F.when(escalates, 5).otherwise(0) + F.when(login_then_pay, 8).otherwise(0)
    return m.select("path", "thread", "score", bonus.alias("bonus"), (escalates | login_then_pay).alias("likely_precursor"))


def new_participants(messages: DataFrame, order: str = "pos") -> DataFrame:
    """path, seen_before (distinct senders earlier in the thread), new: the sender is new to a thread that has begun."""
    w = Window.partitionBy("thread").orderBy(F.asc_nulls_last(order), "path")
    own = Window.partitionBy("thread", "sender").orderBy(F.asc_nulls_last(order), "path")
    first = F.when(F.row_number().over(own) == 1, 1).otherwise(0)
    m = messages.withColumn("is_first", first)
    before = F.coalesce(F.sum("is_first").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return m.select("path", before.alias("seen_before"), ((before > 0) & (F.col("is_first") == 1)).alias("new"))


def earliest_precursor(messages: DataFrame) -> DataFrame:
    """The first likely precursor that a later message follows with a score of at least 10 and no less than one below
    its own: one row, or none. messages: path, day, score, likely_precursor. Ranks by day; later means a later day, or a
    later path on the same day, and is found by per-day maxima, so no task orders the whole corpus."""
    by_day = messages.groupBy("day").agg(F.max("score").alias("best"))
    days = by_day.select("day", F.max("best").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))  # a row for each day
    same = F.max("score").over(Window.partitionBy("day").orderBy("path").rowsBetween(1, Window.unboundedFollowing))
    m = messages.withColumn("same_day", same).join(F.broadcast(days), "day", "left")
    top = F.greatest("same_day", "after")
    hit = m.filter(F.col("likely_precursor") & (top >= F.greatest(F.lit(10), F.col("score") - 1)))
    return hit.select("path", "day", "score", top.alias("followed_by")).orderBy("day", "path").limit(1)


def shared_precursor(messages: DataFrame, strong: int = 35) -> DataFrame:
    """One row, or none: the earliest message with telling evidence that shares a campaign, a URL's domain or a file's hash
    with another, suspicious one: path, sec, evidence, confidence, shared_with (how many).

    messages: path, sec, score, stage, campaign, domains, hashes, evidence (arrays). Suspicious are scores of `strong` and
    more, and stages after first contact. Keys meet by an equi-join; of each key only the suspicious paths' number and
    lowest two are carried, so a hot key costs one row."""
    # Words of evidence that tells, and stages that are suspicious.
    words = ("credential", "login", "phishing", "suspicious url", "impersonat", "attachment", "payment", "redirect", "punycode", "userinfo", "ip address")
    stages = ("credential_harvest", "payment_request", "attachment_delivery", "suspicious_link")
    telling = F.filter("evidence", lambda e: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(e).contains(w)))
    keys = F.array_distinct(F.concat(F.when(F.coalesce("campaign", F.lit("")) != "", F.array(F.concat(F.lit("c:"), "campaign"))).otherwise(F.array().cast("array<string>")), F.transform("domains", lambda d: F.concat(F.lit("d:"), d)), F.transform("hashes", lambda h: F.concat(F.lit("h:"), h))))
    m = messages.select("path", "sec", telling.alias("evidence"), F.explode(keys).alias("key"), ((F.col("score") >= strong) | F.col("stage").isin(*stages)).alias("bad"))
    by_key = m.filter("bad").groupBy("key").agg(F.count("*").alias("n"))
    hit = m.filter(F.size("evidence") > 0).join(by_key, "key").withColumn("others", F.col("n") - F.col("bad").cast("long")).filter("others > 0")
    one = hit.groupBy("path", "sec", "evidence").agg(F.max("others").alias("shared_with")).orderBy(F.asc_nulls_last("sec"), "path").limit(1)
    return one.withColumn("confidence", F.when(F.size(F.array_distinct("evidence")) >= 2, "high").otherwise("medium"))
