"""URL expressions. A URL is split by one pattern, which malformed links pass too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave import config as C
from caseweave.functions.address import IPV4, registrable_domain

SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)"
IN_TEXT = r"(?i)((https?://|www\.)[^\s<>\"')]+)"


def normalize_url(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(F.lower(u).startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u)


def parts(url: Column) -> dict[str, Column]:
    """scheme, authority, host (lower case, no port, no final dot), port, path, query of a URL."""
    u = normalize_url(url)
    authority = F.regexp_extract(u, SPLIT, 2)
    place = F.substring_index(authority, "@", -1)
    return {
        "url": u, "scheme": F.lower(F.regexp_extract(u, SPLIT, 1)), "authority": authority,
        "host": F.lower(F.regexp_replace(F.regexp_replace(place, r":[0-9]*$", ""), r"\.+$", "")),
        "port": F.nullif(F.regexp_extract(place, r":([0-9]+)$", 1), F.lit("")).cast("int"),
        "path": F.regexp_extract(u, SPLIT, 3), "query": F.regexp_extract(u, SPLIT, 4),
    }


def parameters(query: Column) -> Column:
    """Names of the query's parameters, lower case, as often as they stand."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)))


def _any_suffix(host: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out |= host.endswith(s)
    return out


def _any_within(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in needles:
        out |= text.contains(s)
    return out


def is_ip(host: Column) -> Column:
    return host.rlike(f"^{IPV4}$") | host.contains(":")


def risk_rules(url: Column, displayed: Column | None = None) -> dict[str, tuple[Column, int]]:
    """The risk rules by name: whether each holds, and its weight."""
    p = parts(url)
    names = parameters(p["query"])
    rules = {
        "scheme": (~p["scheme"].isin("http", "https"), 5), "http": (p["scheme"] == "http", 2), "userinfo": (p["authority"].contains("@"), 6), "ip": (is_ip(p["host"]), 6),
        "punycode": (p["host"].startswith("xn--") | p["host"].contains(".xn--"), 3), "shortener": (p["host"].isin(*C.SHORTENERS), 3), "tld": (_any_suffix(p["host"], C.RISKY_TLDS), 2),
        "long_host": (F.length(p["host"]) > 60, 2), "nested": (F.length(p["host"]) - F.length(F.replace(p["host"], F.lit("."), F.lit(""))) >= 4, 2), "at": (p["authority"].contains("@"), 4),
        "redirect": (F.arrays_overlap(names, F.array(*[F.lit(x) for x in C.RISK_PARAMETERS])), 3), "auth_path": (_any_within(F.lower(p["path"]), C.AUTH_PATHS), 2), "long": (F.length(p["url"]) > 180, 2),
    }
    if displayed is not None:
        shown = parts(displayed)["host"]
        rules["display"] = ((shown != "") & (p["host"] != "") & (shown != p["host"]), 7)
    return rules


def risk_score(url: Column, displayed: Column | None = None) -> Column:
    return sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for c, w in risk_rules(url, displayed).values()), F.lit(0))


def suspicion_score(url: Column) -> Column:
    """The second score: other weights, and each redirecting parameter and each value with an @ counts."""
    p = parts(F.trim(F.coalesce(url, F.lit(""))))
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x != "")
    redirects = F.size(F.filter(parameters(p["query"]), lambda n: n.isin(*C.REDIRECT_PARAMETERS)))
    at = F.size(F.filter(pairs, lambda x: F.regexp_extract(x, "=(.*)", 1).contains("@") | F.lower(F.regexp_extract(x, "=(.*)", 1)).contains("%40")))
    scheme = F.when(~p["scheme"].isin("http", "https"), 15).when(p["scheme"] == "http", 8).otherwise(0)
    flags = [
        (is_ip(p["host"]), 20), (p["authority"].contains("@"), 25), (p["host"].startswith("xn--") | p["host"].contains(".xn--"), 15),
        (p["host"].isin(*C.SUSPICION_SHORTENERS), 12), (F.length(p["host"]) > 80, 8), (F.length(p["path"]) > 120, 5),
    ]
    return sum((F.when(c, w).otherwise(0) for c, w in flags), scheme + 10 * redirects + 5 * at)


def is_navigable(url: Column) -> Column:
    """False for hosts that only name schemas."""
    host = parts(url)["host"]
    out = F.lit(False)
    for h in C.SCHEMA_HOSTS:
        out |= (host == h) | host.endswith("." + h)
    return ~out


def urls_in(text: Column, navigable_only: bool = True) -> Column:
    """Distinct URLs in a text, without punctuation at their end."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IN_TEXT), F.lit(1))
    found = F.filter(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}>\"']+$", ""))), lambda u: u != "")
    return F.filter(found, is_navigable) if navigable_only else found


def registrable(url: Column) -> Column:
    return registrable_domain(parts(url)["host"])
