"""The incident's frame: anchors, the investigation window, the score of a first message, the narrative, the case page."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions import url
from caseweave.operators.rollups import union_all

# Language of lures.
CREDENTIAL_LURES = ("verify your account", "sign in", "login", "password", "confirm your identity", "account suspended", "unusual activity", "reset your password", "security alert")
PAYMENT_TERMS = ("payment", "bank details", "bank account", "routing number", "beneficiary", "remittance", "wire transfer", "account number")
URGENCY_TERMS = ("urgent", "immediately", "as soon as possible", "confidential", "do not call", "today")
BANK_CHANGE_TERMS = ("new bank", "updated bank", "change bank", "changed our bank", "new account details", "updated account")
# Weights of the first-message score.
INITIAL_WEIGHTS = {
    "self_spoofing": 6, "auth_anomaly_corroborated": 4, "auth_anomaly": 1, "lookalike": 7, "reply_to_mismatch": 4, "sending_ip_anomaly": 3,
    "display_name_spoof": 5, "thread_injection": 6, "deleted": 4, "moved": 2, "rule_target": 2, "attachment_credential": 6, "attachment_other": 4,
    "cred_lure": 4, "credential_link": 6, "has_url": 1, "post_compromise_penalty": 8, "pay_lure": 4, "bank_change": 5, "urgency": 2,
    "impersonation_extra": 2, "impersonation_login_url": 2, "anchor": 8, "established_downweight": 3, "first_contact_ask": 3,
}


@dataclass(frozen=True)
class Anchors:
    """What the investigator knows. Texts are compared without case."""

    compromise_sec: int | None = None
    lookback_days: int = 30
    scenario: str = ""
    victims: tuple[str, ...] = ()
    attacker_ips: tuple[str, ...] = ()
    attacker_addresses: tuple[str, ...] = ()
    rule_keywords: tuple[str, ...] = ()
    fraud_accounts: tuple[str, ...] = ()
    impersonated: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    attacker_domains: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    def merged(self, derived: Anchors) -> Anchors:
        """With what the logs say: explicit values win, lists are joined in order without repeats."""
        lists = {n: tuple(dict.fromkeys((*getattr(self, n), *getattr(derived, n)))) for n in ("victims", "attacker_ips", "attacker_addresses", "rule_keywords", "fraud_accounts", "impersonated", "subjects", "attacker_domains")}
        return replace(self, compromise_sec=self.compromise_sec if self.compromise_sec is not None else derived.compromise_sec, scenario=self.scenario or derived.scenario, **lists)

    @property
    def window(self) -> tuple[int, int] | None:
        if self.compromise_sec is None:
            return None
        return self.compromise_sec - self.lookback_days * 86400, self.compromise_sec


def in_lookback(sec: Column, a: Anchors) -> Column:
    """In the run-up to the compromise; true without one; false for an unknown time."""
    if a.window is None:
        return F.lit(True)
    return F.coalesce(sec.between(*a.window), F.lit(False))


def after_compromise(sec: Column, a: Anchors) -> Column:
    return F.lit(False) if a.compromise_sec is None else F.coalesce(sec > a.compromise_sec, F.lit(False))


def relevant(sec: Column, a: Anchors) -> Column:
    return in_lookback(sec, a) | after_compromise(sec, a)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        out |= low.contains(w.lower())
    return out


def _some(texts: Column, part: str) -> Column:
    return F.exists(texts, lambda t: t.contains(part))


def anchor_matches(m: DataFrame, a: Anchors, text: str = "body", sender: str = "sender") -> Column:
    """What of the anchors a message shows, as an array. What asks for columns that m hasn't (sender_name, reply_to,
    sender_domain, urls, origin_ip) is left out."""
    have, low = set(m.columns), F.lower(F.coalesce(F.col(text), F.lit("")))
    answer = F.lower(F.regexp_extract(F.coalesce("reply_to", F.lit("")), r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1)) if "reply_to" in have else F.lit("")
    made = [F.when((F.lower(F.col(sender)) == x.lower()) | (answer == x.lower()), F.lit(f"attacker address {x}")) for x in a.attacker_addresses]
    made += [F.when(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\s-]", "").contains(x.lower().replace(" ", "").replace("-", "")), F.lit(f"account {x}")) for x in a.fraud_accounts]
    made += [F.when(F.lower("subject").contains(x.lower()), F.lit(f"subject {x}")) for x in a.subjects]
    named = F.lower(F.coalesce("sender_name", F.lit(""))) if "sender_name" in have else F.lit("")
    made += [F.when(named.contains(x.lower()) | low.contains(x.lower()), F.lit(f"impersonated party {x}")) for x in a.impersonated if x]
    if "sender_domain" in have:
        hosts = F.transform("urls", lambda u: url.parts(u)["host"]) if "urls" in have else F.array().cast("array<string>")
        made += [F.when((F.col("sender_domain") == x.lower()) | (F.substring_index(answer, "@", -1) == x.lower()) | _some(hosts, x.lower()), F.lit(f"attacker domain {x}")) for x in a.attacker_domains if x]
    if "origin_ip" in have:
        made += [F.when(F.col("origin_ip") == x, F.lit(f"attacker IP {x}")) for x in a.attacker_ips if x]
    return F.filter(F.array(*made) if made else F.array().cast("array<string>"), lambda x: x.isNotNull())


FLAGS = ("self_spoofing", "auth_anomaly", "lookalike", "reply_to_mismatch", "sending_ip_anomaly", "display_name_spoof", "thread_injection", "deleted", "moved", "rule_target", "attachment_credential", "attachment_other", "login_url", "has_url", "established", "first_contact")


def initial_score(m: DataFrame, takeover: bool, a: Anchors) -> Column:
    """How likely a message is the first malicious one. m: inbound, text, sec, anchors (how many match), and the booleans
    FLAGS. Failing authentication counts little unless something else, which the attacker can't help, points the same way."""
    w, f = INITIAL_WEIGHTS, {n: F.coalesce(F.col(n), F.lit(False)) for n in FLAGS}
    cred, pay = any_of(F.col("text"), CREDENTIAL_LURES), any_of(F.col("text"), PAYMENT_TERMS)
    anchored = F.col("anchors") > 0
    backed = f["lookalike"] | f["reply_to_mismatch"] | f["login_url"] | anchored | f["thread_injection"] | f["display_name_spoof"] | f["deleted"] | f["moved"] | f["attachment_credential"] | f["attachment_other"] | (f["first_contact"] & (cred | pay))
    auth = F.when(f["self_spoofing"], w["self_spoofing"]).when(f["auth_anomaly"] & backed, w["auth_anomaly_corroborated"]).when(f["auth_anomaly"], w["auth_anomaly"]).otherwise(0)
    plain = sum((F.when(f[n], w[n]).otherwise(0) for n in ("lookalike", "reply_to_mismatch", "sending_ip_anomaly", "display_name_spoof", "thread_injection", "rule_target")), auth)
    plain = plain + F.when(f["deleted"], w["deleted"]).when(f["moved"], w["moved"]).otherwise(0) + F.when(f["attachment_credential"], w["attachment_credential"]).when(f["attachment_other"], w["attachment_other"]).otherwise(0)
    if takeover:
        link = F.when(f["has_url"] & (f["login_url"] | cred | f["attachment_credential"]), w["credential_link"]).when(f["has_url"], w["has_url"]).otherwise(0)
        plain = plain + F.when(cred, w["cred_lure"]).otherwise(0) + link
        if a.compromise_sec is not None:
            plain = plain - F.when(F.coalesce(F.col("sec") < a.compromise_sec, F.lit(False)), 0).otherwise(w["post_compromise_penalty"])
    else:
        for words, n in ((PAYMENT_TERMS, "pay_lure"), (BANK_CHANGE_TERMS, "bank_change"), (URGENCY_TERMS, "urgency")):
            plain = plain + F.when(any_of(F.col("text"), words), w[n]).otherwise(0)
        plain = plain + F.when(f["self_spoofing"] | f["auth_anomaly"], w["impersonation_extra"]).otherwise(0) + F.when(f["login_url"], w["impersonation_login_url"]).otherwise(0)
    total = plain + F.col("anchors") * w["anchor"]
    own = f["self_spoofing"] | f["auth_anomaly"] | f["lookalike"]
    total = F.when(f["established"] & ~anchored & ~own & (total > 0), total - F.least(total, F.lit(w["established_downweight"]))).when(f["first_contact"] & (cred | pay), total + w["first_contact_ask"]).otherwise(total)
    return F.when(F.col("inbound"), F.greatest(F.lit(0), total)).otherwise(0).cast("long")


def narrative(entry: DataFrame, access: DataFrame, persistence: DataFrame, impact: DataFrame) -> DataFrame:
    """phase, sec, ref, what of four phases in order. Each input: sec, ref, what."""
    parts = [df.select(F.lit(i).alias("seq"), F.lit(name).alias("phase"), "sec", "ref", "what") for i, (name, df) in enumerate((("initial access", entry), ("account access", access), ("persistence", persistence), ("impact", impact)))]
    return union_all(parts).orderBy("seq", F.asc_nulls_last("sec"), "ref").drop("seq")


QUESTIONS = ("entry", "when", "how", "access", "read", "taken", "persistence", "notified", "limits")


def case_page(answers: dict[str, DataFrame]) -> DataFrame:
    """question, answer: nine rows, in order. Each answer is a DataFrame of one column, text; none says not established."""
    rows = []
    for i, q in enumerate(QUESTIONS):
        if q in answers:
            a = answers[q].agg(F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("t")).select(F.lit(i).alias("seq"), F.lit(q).alias("question"), F.when(F.col("t") == "", "not established").otherwise(F.col("t")).alias("answer"))
        else:
            spark = next(iter(answers.values())).sparkSession
            a = spark.range(1).select(F.lit(i).alias("seq"), F.lit(q).alias("question"), F.lit("not established").alias("answer"))
        rows.append(a)
    return union_all(rows).orderBy("seq").drop("seq")
