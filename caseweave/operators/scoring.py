"""Findings as rows, scores as sums, and what is decided from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave import config as C

Rule = tuple[str, str, str, Column, int | Column]

# Sources that a service recorded, and those an investigator supplied.
OBSERVED = ("audit", "entra:", "rdap", "geoip", "persistence", "mailbox_metadata", "corpus:thread", "corpus:lookalike+rdap", "messagetrace")
ASSUMED = ("investigator_anchor",)
# Techniques by a finding's category, and by words of its signal.
TECHNIQUES = {
    "language": "T1566", "url": "T1566.002", "attachment": "T1566.001", "identity": "T1656", "auth": "T1656",
    "thread": "T1534", "concealment": "T1564.008", "headers": "T1036",
}
SIGNAL_TECHNIQUES = (("disguised", "T1036.008"), ("does not match the", "T1036.008"), ("double extension", "T1036.008"), ("macro", "T1204.002"), ("forwards to", "T1114.003"))
# Words of the attack stages, in the order in which they are tried.
STAGES = (
    ("payment_request", None, ("wire", "payment", "invoice", "bank account", "bank details", "routing number", "beneficiary", "gift card", "transfer funds")),
    ("attachment_delivery", "has_attachment", ("attached", "attachment", "document", "invoice")),
    ("credential_harvest", "has_url", ("verify your account", "sign in", "login", "password", "credential", "mfa", "multi-factor", "authentication", "account security")),
    ("social_engineering", None, ("are you available", "quick question", "urgent", "confidential", "let me know when", "can you help")),
)


def severity(weight: Column) -> Column:
    return F.when(weight >= 6, "high").when(weight >= 3, "medium").otherwise("low")


def provenance(source: Column) -> Column:
    """observed, inferred or assumed, by where the evidence came from."""
    def starts(prefixes: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out |= F.coalesce(source, F.lit("")).startswith(p)
        return out

    return F.when(starts(ASSUMED), "assumed").when(starts(OBSERVED), "observed").otherwise("inferred")


def findings(messages: DataFrame, rules: Sequence[Rule], stage: str = "base") -> DataFrame:
    """path, stage, seq, signal, category, source, weight, severity, provenance: one row for each rule that holds.

    rules: (signal, category, source, condition, weight). One pass: the rules are an array that is filtered and exploded."""
    made = F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(i).alias("seq"), F.lit(signal).alias("signal"), F.lit(category).alias("category"), F.lit(source).alias("source"), (w if isinstance(w, Column) else F.lit(w)).cast("long").alias("weight")))
        for i, (signal, category, source, cond, w) in enumerate(rules)
    ])
    x = messages.select("path", F.explode(F.filter(made, lambda f: f.isNotNull())).alias("f"))
    return x.select("path", F.lit(stage).alias("stage"), "f.*", severity(F.col("f.weight")).alias("severity"), provenance(F.col("f.source")).alias("provenance"))


def first_of_signal(f: DataFrame) -> DataFrame:
    """Findings without repeats of a signal on a message: the first stays."""
    rank = F.row_number().over(Window.partitionBy("path", "signal").orderBy("stage", "seq"))
    return f.withColumn("r", rank).filter("r = 1").drop("r")


def scores(messages: DataFrame, f: DataFrame) -> DataFrame:
    """path, score: the sum of the weights, 0 without findings."""
    s = f.groupBy("path").agg(F.sum("weight").alias("w"))
    return messages.select("path").join(s, "path", "left").select("path", F.coalesce("w", F.lit(0)).alias("score"))


def baseline_modifiers(scored: DataFrame, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """path, score, delta, final: what the corpus says about the sender raises or lowers a score above 0, and makes none.

    scored: path, score, n (messages of the domain), auth_seen, auth_pass, state (aligned, partial, failed, absent)."""
    fam = F.when(F.col("n").isNull(), "unknown").when(F.col("n") >= t.established_min, "established").when(F.col("n") > 1, "known").otherwise("new")
    share = F.coalesce(F.try_divide("auth_pass", "auth_seen"), F.lit(0.0))
    enforced = (F.coalesce("auth_seen", F.lit(0)) >= t.enforce_min) & (share >= 0.5)
    failed = F.when(F.col("state") == "failed", F.when(enforced, 6).otherwise(5)).otherwise(0)
    rarity = F.when(fam == "new", F.least(F.greatest(F.lit(1), F.expr("score div 3")), F.lit(6))).when((fam == "established") & (F.col("state") != "failed"), -F.least(F.expr("score div 4"), F.lit(4))).otherwise(0)
    calm = -F.least(F.expr("score div 2"), F.lit(8))
    delta = F.when(F.col("score") <= 0, 0).when((F.col("state") == "aligned") & (fam == "established"), calm).otherwise(failed + rarity)
    return scored.withColumn("delta", delta.cast("long")).withColumn("final", F.when(F.col("score") <= 0, F.col("score")).otherwise(F.greatest(F.lit(0), F.col("score") + F.col("delta"))))


def signal_statistics(f: DataFrame, tiers: DataFrame) -> DataFrame:
    """For each signal: fires, messages, share of the corpus, weight, Tier-1 hits, and the lift of Tier 1 among them."""
    total = F.broadcast(tiers.agg(F.count("*").alias("n"), F.count_if(F.col("tier") == 1).alias("n1")))
    per = f.groupBy("signal", "path").agg(F.count("*").alias("fires"), F.sum("weight").alias("weight"))
    g = per.join(tiers, "path").groupBy("signal").agg(F.sum("fires").alias("fires"), F.count("*").alias("messages"), F.sum("weight").alias("weight"), F.count_if(F.col("tier") == 1).alias("tier1"))
    base = F.col("n1") / F.col("n")
    return g.crossJoin(total).select("signal", "fires", "messages", (F.col("messages") / F.col("n")).alias("share"), "weight", "tier1", F.round(F.try_divide(F.col("tier1") / F.col("messages"), base), 6).alias("lift"))


def techniques(f: DataFrame) -> DataFrame:
    """path, technique: what findings imply, each once."""
    cat = F.element_at(F.create_map(*[F.lit(x) for kv in TECHNIQUES.items() for x in kv]), F.coalesce("category", F.lit("")))
    named = [F.when(F.lower("signal").contains(n), F.lit(t)) for n, t in SIGNAL_TECHNIQUES]
    return f.select("path", F.explode(F.filter(F.array(cat, *named), lambda t: t.isNotNull())).alias("technique")).distinct()


def technique_summary(f: DataFrame) -> DataFrame:
    return techniques(f).groupBy("technique").agg(F.count("*").alias("messages"))


def attack_stage(text: Column, has_attachment: Column, has_url: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    gates = {"has_attachment": has_attachment, "has_url": has_url}
    out = None
    for name, gate, words in STAGES:
        hit = F.lit(False)
        for w in words:
            hit |= low.contains(w)
        hit = hit & gates[gate] if gate else hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(has_url, "suspicious_link").otherwise("initial_contact")


def candidate_screen(m: DataFrame) -> DataFrame:
    """path, score, candidate, reasons of the first pass over all mail. m: path, high, social, urls, url_risk, files, risky,
    auth_fails (counts), base64, bulk (booleans), chars."""
    high, social, urls, fails = F.col("high"), F.col("social") > 0, F.col("urls") > 0, F.col("auth_fails")
    parts = [
        (F.col("base64"), 3, "base64-encoded content in body"), (high >= 2, 5, "multiple high-signal terms"), (high == 1, 2, "high-signal term"),
        (social & ((high > 0) | urls), 3, "social-engineering combination"), (F.col("risky") > 0, 5, "risky attachment type"), (urls & (F.col("url_risk") > 0) & ((high > 0) | social), 2, "suspicious URL context"),
        ((F.col("files") > 0) & (F.col("risky") == 0) & ((high > 0) | social), 1, "attachment with suspicious context"), ((F.col("chars") > 12000) & (high > 0), 1, "large transactional body"),
    ]
    base = sum((F.when(c, w).otherwise(0) for c, w, _ in parts), F.lit(0))
    m = m.withColumn("base", base)
    excused = (fails > 0) & F.col("bulk") & (F.col("base") == 0)
    counted = F.when(excused, 0).otherwise(fails)
    score = F.col("base") + F.least(F.lit(4), counted * 2)
    reasons = [F.when(c, F.lit(r)) for c, _, r in parts] + [F.when(excused, F.lit("authentication anomaly on bulk mail - not promoted")).when(fails > 0, F.lit("authentication anomaly"))]
    candidate = (score >= 5) | ((score >= 4) & ((high > 0) | social | (F.col("risky") > 0) | (counted > 0))) | ((high > 0) & social)
    return m.select("path", score.cast("long").alias("score"), candidate.alias("candidate"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def candidate_reasons(screen: DataFrame) -> DataFrame:
    return screen.filter("candidate").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def tiers(m: DataFrame, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """path, tier. m: path, scenario_score and the booleans inbound, anchored, in_window, relevant, attacker_sent,
    substituted, confirmed, attacker_read, signin_confirmed."""
    tier = (
        F.when(F.col("attacker_sent") | F.col("substituted") | F.col("confirmed"), 1).when(F.col("inbound") & F.col("anchored"), 1)
        .when(F.col("inbound") & F.col("in_window") & (F.col("scenario_score") >= t.tier1), 1).when(F.col("inbound") & (F.col("relevant") | F.col("anchored")) & (F.col("scenario_score") > 0), 2).otherwise(3)
    )
    return m.select("path", F.when(F.col("signin_confirmed"), 1).when(F.col("attacker_read"), F.least(tier, F.lit(2))).otherwise(tier).alias("tier"))


def initial_verdict(m: DataFrame, takeover: bool, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """One row, or none: the most likely first malicious message. In a takeover the earliest strong one of the window (else
    the strongest), else the strongest. m: path, day, scenario_score, in_window, anchored."""
    pool = m.filter(F.col("scenario_score") > 0)
    if takeover:
        pool = pool.filter("in_window")
    best = F.struct((-F.col("scenario_score")).alias("s"), F.coalesce("day", F.lit(1 << 40)).alias("d"), "path")
    early = F.struct(F.coalesce("day", F.lit(1 << 40)).alias("d"), (-F.col("scenario_score")).alias("s"), "path")
    row = F.struct("path", "day", "scenario_score", "anchored")
    strong = F.min_by(F.when(F.col("scenario_score") >= t.tier1, row), F.when(F.col("scenario_score") >= t.tier1, early)) if takeover else F.lit(None).cast("struct<path:bigint,day:bigint,scenario_score:bigint,anchored:boolean>")
    one = pool.agg(F.count("*").alias("pool"), strong.alias("strong"), F.min_by(row, best).alias("best")).filter("pool > 0")
    x = one.select("pool", F.coalesce("strong", "best").alias("x")).select("pool", "x.*")
    sure = F.when(F.col("anchored") & (F.col("scenario_score") >= 16), "high").when(F.col("scenario_score") >= t.tier1, "medium").otherwise("low")
    return x.withColumn("confidence", sure)


def shortlist(m: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest messages, with their rank."""
    top = m.filter("scenario_score > 0").orderBy(F.desc("scenario_score"), F.asc_nulls_last("day"), "path").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("scenario_score"), F.asc_nulls_last("day"), "path")).alias("rank"), "path", "scenario_score")


def term_scale(share: Column, weight: Column, cap: float = C.DEFAULTS.phrase_cap) -> Column:
    """A term's weight, lowered where it is common; halves round to even."""
    return F.when(share > cap, F.bround(weight * (F.lit(cap) / share))).otherwise(weight).cast("long")
