"""PII (10): Aho-Corasick finds anchors, local parsers expand and check what stands around them.

Digits aren't anchors of the automaton: a pattern of C speed lists their runs, which the base kinds need anyway."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ids_only, read_table, small_batches

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds: international account numbers with their check digits, logins inside addresses with a
#: scheme, and what stands after an identifier's cue: secrets, social security, account and passport numbers.
ADDED = ("iban", "login", "secret", "ssn", "account", "passport")
#: Cues of identifiers, in lower case; they are found in lower case, capitals, and with one capital at the start.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "passphrase", "api_key", "api-key", "apikey", "api key", "access_key", "access key", "private_key", "private key", "bearer"),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "iban", "konto", "compte", "cuenta"),
    "passport": ("passport", "reisepass", "passeport", "pasaporte"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGIT = frozenset("0123456789")
_DIGITS = re.compile(r"[0-9]+")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIAL = re.compile(r"[\x20().0-9-]*+")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++(?::[^\s/?#@]*+)?+@[A-Za-z0-9.-]+")
# what may stand between a cue and its value
_ASSIGN = re.compile(r"[A-Za-z0-9_-]{0,12}[\"'`\])]{0,2}\s{0,3}(?::=|=>|==|=|:|\bis\b)\s{0,3}[\"'`]?")
_BLANK = re.compile(r"\s{1,3}")
_NUMBERED = re.compile(r"s?(?:[\s_-]{0,2}(?:no|nr|num|number|nummer|id)\b\.?)?[\"'`]?\s{0,2}(?:\bis\b|:=|[:#=])?\s{0,2}[\"'`]?(?=[A-Z0-9])", re.IGNORECASE)
_SECRET = re.compile(r"[A-Za-z0-9_+/.~!$%^&*#@=-]{8,512}+")
_SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}([\x20-]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){6,16}(?![A-Za-z0-9])")
_PASS_NO = re.compile(r"(?=[A-Z]*[0-9])[A-Z]{0,2}[0-9][A-Z0-9]{5,8}(?![A-Za-z0-9])")


def automaton():
    """Anchors: at-signs, schemes, dial prefixes, and the cues of identifiers. Values: (kind, length of the cue)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for sign, kind in (("@", "@"), ("://", "://"), ("+", "+")):
        a.add_word(sign, (kind, len(sign)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for a in ats:
        s = a
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < a and (m := _HOST.match(text, a + 1)):
            end = m.end()
            yield s, end


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(four[j][1] + 1 == four[j + 1][0] and text[four[j][1]] == "." for j in range(3)):
            parts = [text[s:e].lstrip("0") for s, e in four]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 16 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[i : j + 1])):
            yield runs[i][0], runs[j][1]
        i = j + 1


def _phones(text: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    for p in pluses:
        if text[p + 1 : p + 2] not in _DIGIT:
            continue
        e = _DIAL.match(text, p + 2).end()
        while e > p + 3 and text[e - 1] not in _DIGIT:
            e -= 1
        if e > p + 3 and 8 <= sum(c in _DIGIT for c in text[p:e]) <= 15:
            yield p, e


def _ibans(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    end = 0
    for s, _ in runs:
        a = s - 2
        if a < end or a and text[a - 1].isalnum() or not (m := _ACCOUNT.match(text, a)):
            continue
        # what follows may look like more of it: the longest whose check digits hold, of some 60 ends at most
        for e in range(m.end(), a + 14, -1):
            if text[e - 1] == " " or _ALNUM.match(text, e):
                continue
            plain = text[a:e].replace(" ", "")
            if len(plain) < 15:
                break
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                end = e
                yield a, end
                break


def _logins(text: str, schemes: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for a in schemes:
        s = a
        while s > end and text[s - 1] in _SCHEME:
            s -= 1
        if s < a and (m := _LOGIN.match(text, a + 3)):
            end = m.end()
            yield s, end


def _secrets(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """After the cue a sign of assignment (after `bearer` a blank will do), then eight or more characters with a letter
    and a digit among them, which words of prose seldom have."""
    end = 0
    for a, e in cues:
        if a < end:
            continue
        m = _ASSIGN.match(text, e) or (_BLANK.match(text, e) if text[a:e].lower() == "bearer" else None)
        v = m and _SECRET.match(text, m.end())
        if not v:
            continue
        value = v.group().rstrip(".!")
        if len(value) >= 8 and any(c in _DIGIT for c in value) and any(c.isalpha() for c in value):
            end = v.start() + len(value)
            yield v.start(), end


def _numbered(text: str, cues: list[tuple[int, int]], number: re.Pattern) -> Iterator[tuple[int, int]]:
    """A number right after the cue, but for words such as `no.` or `number` and a sign."""
    end = 0
    for a, e in cues:
        m = _NUMBERED.match(text, e) if a >= end else None
        v = m and number.match(text, m.end())
        if v:
            end = v.end()
            yield v.span()


def _apart(spans: list[tuple[int, int]], *others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that no other overlaps."""
    taken = sorted(x for o in others for x in o)
    out, i = [], 0
    for s, e in spans:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            out.append((s, e))
    return out


def find(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind in the whole text, in order. Time is linear in its length."""
    at: dict[str, list[tuple[int, int]]] = {}
    for last, (kind, n) in anchors.iter(text):
        at.setdefault(kind, []).append((last + 1 - n, last + 1))
    runs = [m.span() for m in _DIGITS.finditer(text)]
    if not at and not runs:
        return {}
    ats, pluses = ([a for a, _ in at.get(sign, ())] for sign in "@+")
    out = {"email": list(_emails(text, ats)), "ip": list(_ips(text, runs)), "card": list(_cards(text, runs)), "phone": list(_phones(text, pluses))}
    out["iban"] = list(_ibans(text, runs))
    out["login"] = list(_logins(text, [a for a, _ in at.get("://", ())])) if ats else []
    # values of cues have a digit; what another kind has found isn't found again
    cues = {kind: at.get(kind, []) if runs else [] for kind in CUES}
    out["secret"] = _apart(list(_secrets(text, cues["secret"])), *(out[k] for k in ("email", "ip", "phone", "login")))
    out["ssn"] = _apart(list(_numbered(text, cues["ssn"], _SOCIAL)), out["card"], out["phone"], out["ip"])
    out["account"] = _apart(list(_numbered(text, cues["account"], _NUMBER)), *(out[k] for k in (*BASE, "iban", "secret", "ssn")))
    out["passport"] = _apart(list(_numbered(text, cues["passport"], _PASS_NO)), *(out[k] for k in (*BASE, "iban", "secret", "ssn")))
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """Personal data in each whole text: doc_id and spans, an array of (kind, start, end) by kind, then start.

    docs: doc_id, text and other columns, which are ignored. Kinds are email, ip, card, phone, leftmost and
    non-overlapping within a kind, then those the method adds: iban (check digits must hold), login
    (scheme://user:password@host), and after a cue secret, ssn, account and passport. One pass, no shuffle. Null or empty text: no spans. Repeated rows each return a row. Empty table: no rows.
    """
    kind_type = ids_only(docs, ("doc_id",)).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            found = []
            for text in b.column("text"):
                spans = find(text.as_py() or "", anchors)
                found.append([{"kind": k, "start": s, "end": e} for k in (*BASE, *ADDED) for s, e in spans.get(k, ())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, span)], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return ids_only(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {kind_type}, spans array<struct<kind:string,start:long,end:long>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many of each base kind, a digest of these spans, and all spans."""
    got = pii_spans(read_table(spark, sf_dir, "documents"))

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = of(*BASE)
    return got.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
