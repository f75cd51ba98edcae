"""Text expressions: terms, tokens, entropy, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave import config as C


def term_pattern(phrase: str) -> str:
    """A whole-word pattern for a phrase: any blanks between its words, no letter or digit at an edge that is one."""
    body = r"\s+".join(re.escape(w) for w in phrase.lower().split())
    left = r"(^|[^a-z0-9_])" if re.match(r"\w", phrase) else ""
    right = r"([^a-z0-9_]|$)" if re.search(r"\w$", phrase) else ""
    return left + body + right


def term_present(text: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text; a plain search for its first word goes first, as most texts lack it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains(phrase.lower().split()[0]) & low.rlike(term_pattern(phrase))


def terms_present(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that stand in the text, in their order."""
    return F.filter(F.array(*[F.when(term_present(text, p), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())


def token_set(text: Column) -> Column:
    """Distinct runs of three or more of a-z and 0-9, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(w) for w in C.STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 0 if either is empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / all_)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def clean(text: Column) -> Column:
    """One blank in place of each run of blanks, none at the edges."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalize_subject(subject: Column) -> Column:
    """Without reply and forward prefixes, lower case, single blanks."""
    return F.lower(clean(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^(\s*(re|fw|fwd)\s*:\s*)+", "")))


def homoglyph_canon(name: Column) -> Column:
    """Look-alike characters and pairs mapped to one form."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), "01345678$@", "oleasgtbsa")
    return F.regexp_replace(F.regexp_replace(plain, "rn", "m"), "vv", "w")


def looks_alike(a: Column, b: Column, shortest: int = 5) -> Column:
    """Different names of one canonical form, or one edit apart."""
    near = F.levenshtein(a, b, 1).between(1, 1)
    return (a != b) & (F.length(a) >= shortest) & ((homoglyph_canon(a) == homoglyph_canon(b)) | (near & (F.abs(F.length(a) - F.length(b)) <= 1)))


def alike_keys(name: Column) -> Column:
    """Keys of which two names that looks_alike() accepts share one: the canonical form, the name, and the name without
    each one of its characters (names an edit apart share one of these). For an equi-join in place of all pairs."""
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.lit("n:"), F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("c:"), homoglyph_canon(name)), F.concat(F.lit("n:"), name)), cuts))


def defang(text: Column) -> Column:
    """URLs and addresses that can't be clicked."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)http", "hxxp")
    out = F.regexp_replace(out, r"([A-Za-z0-9])\.([A-Za-z0-9])", r"$1[.]$2")
    return F.regexp_replace(out, "@", "[@]")


def template(text: Column) -> Column:
    """A signal's text with its particulars masked, in the order of TEMPLATE_RULES."""
    out = F.coalesce(text, F.lit(""))
    for pattern, mask in TEMPLATE_RULES:
        out = F.regexp_replace(out, pattern, mask)
    return clean(out)


# What a signal may hold that identifies someone, and the masks, in the order in which they are applied.
TEMPLATE_RULES = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<timestamp>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<date>"),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", "<time>"),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b[0-9A-Fa-f:]{2,}:[0-9A-Fa-f:]{2,}\b", "<ip6>"),
    (r"https?://\S+", "<url>"),
    (r"\b[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+\.[A-Za-z]{2,}\b", "<domain>"),
    (r"\b[A-Za-z0-9\-]{2,}\.[A-Za-z]{2,24}\b", "<domain>"),
    (r"[A-Za-z]:\\[^\s'\"]+", "<path>"),
    (r"(?<![A-Za-z0-9])/[^\s'\"]{2,}", "<path>"),
    (r"<[^@\s>]+@[^\s>]+>", "<message-id>"),
    (r"'[^']{1,200}'", "'<value>'"),
    (r"\"[^\"]{1,200}\"", "\"<value>\""),
    (r"\b(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{12,}\b", "<value>"),
    (r"\b[A-Fa-f0-9]{16,64}\b", "<hash>"),
    (r"\((?=[^)\s]*(?:\d|[^)\s]{13}))[^)\s<]{2,}\)", "(<value>)"),
    (r"(?<![A-Za-z0-9])\d[\d,]*", "<n>"),
)


def normalize_block(block: Column, chars: int = 2000) -> Column:
    """A block to compare by: lower case, URLs and numbers masked, single blanks; its first `chars` characters."""
    low = F.lower(F.substring(block, 1, chars))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"https?://\S+", " url "), "[0-9]+", "0"), r"\s+", " "))


def block_hash(block: Column) -> Column:
    return F.substring(F.sha1(normalize_block(block)), 1, 16)


def snippet(text: Column, n: int = 160) -> Column:
    c = clean(text)
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("..."))).otherwise(c)


def name_key(name: Column) -> Column:
    """A person's name to compare by: no punctuation, no single letters, words in order."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N} ]", " ")), r"\s+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: F.length(w) > 1)), " ")
