"""Times in the spellings of mail headers and log exports, as timestamps of UTC; null where unparseable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "yyyy-MM-dd H:mm:ss")


def parse_iso(value: Column, day_first: bool = False) -> Column:
    """ISO 8601 with any zone and fraction, or the month-first (and, if wanted, day-first) forms of exports."""
    v = F.trim(F.coalesce(value, F.lit("")))
    v = F.when(F.lower(v).isin("", "null", "none", "n/a"), None).otherwise(v)
    iso = F.regexp_replace(v, r"(\.\d{6})\d+", "$1")
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.when(iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))).when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(iso, F.lit("T00:00:00Z")))
    tries = [iso.try_cast("timestamp")] + [F.try_to_timestamp(F.concat(v, F.lit(" +0000")), F.lit(f + " Z")) for f in (*FORMATS, *(["d/M/yyyy H:mm:ss"] if day_first else []))]
    return F.coalesce(*tries)


def parse_rfc2822(value: Column) -> Column:
    """A Date header: with or without its weekday, seconds and zone name in brackets; without a zone it is UTC."""
    v = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\([^)]*\)", ""))
    v = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3,9},?\s+", ""), r"\s+", " ")
    v = F.regexp_replace(F.regexp_replace(v, r" (GMT|UTC|UT|Z)$", " +0000"), r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}) ", "$1:00 ")
    v = F.when(v.rlike(r"[+-]\d{4}$"), v).otherwise(F.concat(v, F.lit(" +0000")))
    return F.coalesce(F.try_to_timestamp(v, F.lit("d MMM yyyy H:mm:ss Z")), parse_iso(value))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
