"""Mail addresses, domains and IPv4 addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave import config as C
from caseweave.functions.text import entropy

ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def normalize_email(header: Column) -> Column:
    """The bare address of a header, lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(header, F.lit("")), r"[^\s<>\"',;]+@[^\s<>\"',;]+", 0))


def domain_of(address: Column) -> Column:
    """After the last @; empty without one."""
    a = F.coalesce(address, F.lit(""))
    return F.when(a.contains("@"), F.lower(F.substring_index(a, "@", -1))).otherwise("")


def normalize_message_id(value: Column) -> Column:
    """`<lower case>`; empty for an empty value."""
    bare = F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "[<>]", "")))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("<"), bare, F.lit(">")))


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, or three under a suffix of two labels that is known; an IPv4 address as it is."""
    labels = F.filter(F.split(F.lower(F.coalesce(host, F.lit(""))), r"\."), lambda x: x != "")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(F.coalesce(host, F.lit("")).rlike(f"^{IPV4}$"), host).when(n == 0, "").when(two.isin(*C.TWO_LABEL_SUFFIXES) & (n >= 3), three).otherwise(two)


def addresses(text: Column) -> Column:
    """Distinct addresses in a text, lower case, by first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ADDRESS})"), F.lit(1)), F.lower))


def ipv4s(text: Column) -> Column:
    """Distinct IPv4 literals in a text whose parts are at most 255."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({IPV4})"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda ip: F.forall(F.split(ip, r"\."), lambda p: p.cast("int") <= 255))


def ipv4_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    return sum((F.element_at(p, i + 1).cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))


def is_public_ipv4(ip: Column) -> Column:
    """Not private, loopback, link-local, shared, multicast or reserved."""
    n = ipv4_number(ip)
    out = F.lit(True)
    for base, bits in (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 3)):
        lo = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        out &= ~n.between(lo, lo + (1 << (32 - bits)) - 1)
    return out


def looks_random(local: Column) -> Column:
    """A local part as a machine makes it: long, letters and digits mixed, much entropy."""
    digits = F.length(F.regexp_replace(local, "[^0-9]", ""))
    return (F.length(local) >= 12) & (digits >= F.length(local) * 0.2) & local.rlike("[A-Za-z]") & (entropy(local) >= 3.5)
