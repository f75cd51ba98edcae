"""A whole sign-in log: device code, adversary in the middle, fatigue, spray, legacy protocols; and what it gives a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.checkpoint import materialize
from caseweave.operators import enrich as E
from caseweave.operators import joins as J
from caseweave.operators import signin as S


def prepared(signins: DataFrame) -> DataFrame:
    """A sign-in log as exports.read_signins() gives it, with event_id and what the rules ask: token_claim, single_factor,
    device_code."""
    token, need = F.lower(F.trim("token_type")), F.regexp_replace(F.lower(F.trim("requirement")), " ", "")
    return materialize(signins.withColumns({
        "event_id": F.monotonically_increasing_id(), "token_claim": (token != "") & ~token.isin("none", "primaryrefreshtoken"), "single_factor": need.isin("singlefactorauthentication", "singlefactor"),
        "device_code": S.is_device_code(F.col("transfer"), F.col("protocol")),
    }))


def analyze(signins: DataFrame, attacker_ips: tuple[str, ...] = (), affected: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Frames by name: log (the prepared rows), groups (device-code correlations, with those of one leg resolved by
    attacker_ips), single_legs, aitm, fatigue, spray, legacy, and tokens (successful device-code sign-ins: id, user, sec, ip)."""
    s = prepared(signins)
    legs = s.filter("device_code AND corr <> ''")
    groups = S.resolve_single_groups(S.device_code_groups(legs), legs, attacker_ips)
    apps = legs.filter("app <> ''").groupBy("app").agg(F.count("*").alias("seen"))
    total = F.broadcast(apps.agg(F.sum("seen").alias("all")))
    # a client with a good part of the tenant's device-code sign-ins is normal here
    usual = apps.crossJoin(total).select(F.col("app").alias("usual_app"), ((F.col("seen") >= 10) & (F.col("seen") >= 0.1 * F.col("all"))).alias("expected"))
    single = legs.join(usual, F.col("app") == F.col("usual_app"), "left").withColumns({"expected": F.coalesce("expected", F.lit(False)), "no_access_policy": F.lit(False)})
    return {
        "log": s, "groups": groups, "single_legs": S.single_leg_scores(single), "aitm": S.aitm_scores(s).filter("score >= 3"), "fatigue": S.mfa_fatigue(s), "spray": S.password_spray(s),
        "legacy": S.legacy_auth(s, affected, attacker_ips), "tokens": legs.filter("ok").select(F.col("event_id").alias("id"), F.lower("user").alias("user"), "sec", "ip"),
    }


def confirmed_lures(messages: DataFrame, tokens: DataFrame, window_sec: int = 1200) -> DataFrame:
    """path: messages that send their reader to the device login page, and arrived within the window before a token of
    one of their recipients. messages: path, body, sec, recipients."""
    lures = messages.filter(E.device_code_lure(F.col("body")).isNotNull()).select(F.col("path").alias("id"), F.explode("recipients").alias("user"), "sec")
    return J.lure_window(lures.withColumn("user", F.lower("user")), tokens.select("id", "user", "sec"), window_sec).select(F.col("lure").alias("path")).distinct()
