"""Headers about authentication and transport."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave.functions.address import IPV4, registrable_domain
from caseweave.functions.timeparse import parse_rfc2822

MECHANISMS = ("spf", "dkim", "dmarc", "compauth")


def auth_detail(headers: Column) -> Column:
    """mechanism to (result, reason) of Authentication-Results headers; the first statement of a mechanism counts."""
    parts = F.flatten(F.transform(headers, lambda h: F.split(F.lower(h), ";")))
    entries = []
    for m in MECHANISMS:
        pattern = rf"(?:^|\s){m}=([a-z]+)"
        hit = F.try_element_at(F.filter(parts, _matches(pattern)), F.lit(1))
        result = F.regexp_extract(hit, pattern, 1)
        entries.append(F.when(hit.isNotNull(), F.struct(F.lit(m).alias("key"), F.struct(result.alias("result"), F.regexp_extract(hit, r"reason=\"?([^\";]+)", 1).alias("reason")).alias("value"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def _matches(pattern: str):
    return lambda p: p.rlike(pattern)


def auth_flags(detail: Column, received_spf: Column) -> Column:
    """A struct of spf_pass, spf_fail, dkim_pass, dkim_fail, dmarc_pass, dmarc_fail, compauth_fail."""
    out = []
    for m in ("spf", "dkim", "dmarc"):
        r = F.coalesce(F.try_element_at(detail, F.lit(m))["result"], F.lit(""))
        if m == "spf":
            r = F.when(r == "", F.regexp_extract(F.lower(F.coalesce(F.try_element_at(received_spf, F.lit(1)), F.lit(""))), r"^\s*([a-z]+)", 1)).otherwise(r)
        out += [(r == "pass").alias(f"{m}_pass"), r.isin("fail", "softfail", "permerror").alias(f"{m}_fail")]
    comp = F.coalesce(F.try_element_at(detail, F.lit("compauth"))["result"], F.lit(""))
    return F.struct(*out, (comp == "fail").alias("compauth_fail"))


def auth_state(f: Column) -> Column:
    """failed, aligned (DMARC, or both SPF and DKIM), partial or absent."""
    fail = f["dmarc_fail"] | (f["spf_fail"] & f["dkim_fail"]) | f["compauth_fail"]
    return F.when(fail, "failed").when(f["dmarc_pass"] | (f["spf_pass"] & f["dkim_pass"]), "aligned").when(f["spf_pass"] | f["dkim_pass"], "partial").when(f["spf_fail"] | f["dkim_fail"], "failed").otherwise("absent")


def hop_time(hop: Column) -> Column:
    return parse_rfc2822(F.substring_index(hop, ";", -1))


def arrival(received: Column, date_ts: Column) -> Column:
    """The newest hop's time, else the Date header's."""
    first = F.try_element_at(received, F.lit(1))
    return F.coalesce(F.when(first.contains(";"), hop_time(first)), date_ts)


def received_anomaly(received: Column, external: Column, slack_sec: int = 300) -> Column:
    """missing, single hop (of external mail), out of order (a later hop is older by more than the slack), or empty."""
    times = F.filter(F.transform(F.reverse(received), lambda h: F.unix_seconds(hop_time(h))), lambda t: t.isNotNull())
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("bad"))
    bad = F.aggregate(times, zero, lambda acc, t: F.struct(F.greatest(acc["last"], t).alias("last"), (acc["bad"] | F.coalesce(t < acc["last"] - slack_sec, F.lit(False))).alias("bad")))["bad"]
    n = F.coalesce(F.size(received), F.lit(0))
    return F.when(n <= 0, "missing").when(bad, "out of order").when((n == 1) & external, "single hop").otherwise("")


def date_anomaly(date_raw: Column, date_ts: Column, delivered: Column) -> Column:
    """missing, unparseable, future (more than a day after delivery), or empty."""
    return F.when(F.trim(F.coalesce(date_raw, F.lit(""))) == "", "missing").when(date_ts.isNull(), "unparseable").when(F.unix_seconds(date_ts) > F.unix_seconds(delivered) + 86400, "future").otherwise("")


def message_id_domain(message_id: Column) -> Column:
    return registrable_domain(F.regexp_extract(F.lower(F.coalesce(message_id, F.lit(""))), r"@([^>@\s]+)", 1))


def dkim_domains(signatures: Column) -> Column:
    found = F.flatten(F.transform(signatures, lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"(?:^|[;\s])d=([^;\s]+)"), F.lit(1))))
    return F.array_distinct(F.transform(found, registrable_domain))


def origin_ip(x_originating: Column, received: Column) -> Column:
    """The first IPv4 of X-Originating-IP, else of the oldest hop; empty without one."""
    own = F.regexp_extract(F.coalesce(F.try_element_at(x_originating, F.lit(1)), F.lit("")), IPV4, 0)
    hop = F.regexp_extract(F.coalesce(F.try_element_at(received, F.lit(-1)), F.lit("")), IPV4, 0)
    return F.when(own != "", own).otherwise(hop)


def folder_hint(path: Column) -> Column:
    """deleted or moved, by the first marker in a path; empty otherwise."""
    low = F.lower(F.coalesce(path, F.lit("")))
    out = None
    for marker, kind in (("deleted items", "deleted"), ("trash", "deleted"), ("recoverable items", "deleted"), ("rss", "moved"), ("junk", "moved"), ("archive", "moved"), ("conversation history", "moved")):
        out = F.when(low.contains(marker), kind) if out is None else out.when(low.contains(marker), kind)
    return out.otherwise("")


def fail_reason(detail: Column, most: int = 200) -> Column:
    """Why authentication failed, in words: the failing mechanisms of auth_detail() with their reasons."""
    said = []
    for m in ("dmarc", "spf", "dkim", "compauth"):
        d = F.try_element_at(detail, F.lit(m))
        text = F.concat(F.lit(f"{m}="), d["result"], F.when(F.coalesce(d["reason"], F.lit("")) != "", F.concat(F.lit(" "), d["reason"])).otherwise(""))
        said.append(F.when(d["result"].isin("fail", "softfail", "permerror", "temperror", "none"), text))
    return F.substring(F.array_join(F.filter(F.array(*said), lambda x: x.isNotNull()), "; "), 1, most)
