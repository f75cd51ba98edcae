"""HTML expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def html_to_text(html: Column) -> Column:
    """Without scripts, styles and tags; single blanks."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    """href and visible text of each anchor, in order."""
    h = F.coalesce(html, F.lit(""))
    hrefs = F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(1))
    texts = F.transform(F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(2)), html_to_text)
    return F.arrays_zip(hrefs.alias("href"), texts.alias("text"))


def has_login_form(html: Column) -> Column:
    """A form, or a password field."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return low.contains("<form") | low.rlike(r"<input[^>]*type\s*=\s*[\"']?password")
