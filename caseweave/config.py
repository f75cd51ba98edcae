"""Thresholds, weights and word lists. Immutable; every operator takes what it needs as an argument."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Phrases of lures and their weights.
PHISHING_TERMS = {
    "verify your account": 5, "verify your identity": 5, "confirm your identity": 5, "confirm your account": 5,
    "verify your email": 4, "account verification": 4, "password": 2, "reset your password": 5,
    "change your password": 4, "login": 2, "sign in": 4, "log in": 2, "authenticate": 3, "authentication": 3,
    "security alert": 4, "suspicious activity": 4, "unusual activity": 4, "account suspended": 5,
    "account locked": 5, "action required": 3, "urgent": 3, "immediately": 2, "within 24 hours": 4,
    "click here": 4, "click the link": 4, "open the link": 3, "secure message": 3, "secure document": 3,
    "shared document": 3, "document has been shared": 4, "invoice": 1, "payment": 1, "wire transfer": 5,
    "bank account": 3, "bank details": 4, "change bank": 5, "change banking": 5, "new bank account": 5,
    "updated bank details": 5, "gift card": 5, "confidential": 2, "keep this confidential": 4,
    "do not call": 5, "do not tell": 5, "don't tell": 5,
}

# Hosts and parameters that the URL rules look for.
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "tiny.one")
SUSPICION_SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rebrand.ly", "shorturl.at", "rb.gy")
RISKY_TLDS = (".zip", ".mov", ".click", ".top", ".xyz", ".shop", ".live", ".icu", ".buzz", ".cam", ".support", ".work", ".download")
RISK_PARAMETERS = ("url", "u", "uri", "redirect", "redirect_url", "redirect_uri", "next", "continue", "dest", "destination", "target", "link", "return", "returnurl", "goto", "to")
REDIRECT_PARAMETERS = ("url", "u", "uri", "target", "dest", "destination", "redirect", "redirect_url", "redirect_uri", "next", "continue", "return", "returnurl", "link")
AUTH_PATHS = ("login", "signin", "sign-in", "verify", "auth", "password", "secure", "account")
SCHEMA_HOSTS = ("w3.org", "schemas.microsoft.com", "schemas.openxmlformats.org", "schemas.xmlsoap.org", "openoffice.org", "oasis-open.org", "purl.org", "ns.adobe.com", "iptc.org", "whatwg.org")
# Public suffixes of two labels that are known here.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "co.nz", "com.br", "co.jp", "com.mx", "co.za", "com.sg", "com.tr")
# Words that carry no meaning for comparing texts.
STOP_WORDS = ("the", "and", "for", "this", "that", "with", "from", "your", "you", "are", "was", "has", "have", "will", "can", "please", "hello", "thanks", "thank", "regards")

# Audit operations by what they do (lower case).
DELETE_OPS = ("harddelete", "softdelete", "movetodeleteditems")
SEND_OPS = ("send", "sendas", "sendonbehalf")
RULE_OPS = ("new-inboxrule", "set-inboxrule", "updateinboxrules", "set-mailbox")
DELIBERATE_OPS = ("harddelete", "softdelete", "movetodeleteditems", "movetofolder", "move", "send", "sendas", "sendonbehalf", "update")
EXFIL_OPS = ("filedownloaded", "filesyncdownloadedfull", "filesyncdownloadedpartial")
SHARE_OPS = ("sharingset", "sharinglinkcreated", "anonymouslinkcreated", "companylinkcreated", "securelinkcreated", "addedtosecurelink")
FILE_OPS = ("fileaccessed", "fileaccessedextended", "filepreviewed", "fileuploaded", "filesyncuploadedfull", "filesyncuploadedpartial", "filemodified", "filemodifiedextended", "filecopied", "filemoved", "filedeleted", "filerecycled", "filerenamed", "anonymouslinkused", *EXFIL_OPS, *SHARE_OPS)
# Client classes in the order in which they are tried, and what their strings contain.
CLIENT_CLASSES = (
    ("system", ("client=restsystem", "restsystem", "client=substrate", "substrate", "client=exchange;", "mailboxassistant", "client=ms-exchange-", "microsoft.exchange.")),
    ("powershell", ("powershell", "remoteps", "client=exo", "exchange online powershell")),
    ("ews", ("client=webservices", "exchangewebservices", "ews/")),
    ("activesync", ("client=activesync", "activesync", "outlook-ios", "outlook-android", "client=outlookservice")),
    ("mobile", ("outlook mobile", "client=outlook mobile", "iphone", "android", "ipad")),
    ("owa", ("client=owa", "action=viaproxy")),
    ("desktop", ("client=msexchangerpc", "msexchangerpc", "client=hx", "mapi", "client=outlookdesktop")),
    ("rest", ("client=rest", "graph")),
)
# Sign-in error codes.
BAD_PASSWORD_CODES = ("50126", "50053", "50055", "50057")
MFA_GATE_CODES = ("50074", "50076", "500121", "50079", "50072")
# Phrases of texts that speak about lures, and the phrases of lures that mean nothing there.
NEGATIVE_CONTEXT = (
    "security awareness", "phishing simulation", "simulated phish", "test phish", "do not click any links", "this is a test", "report suspicious", "if you receive an email asking",
    "we will never ask", "never ask you for your password", "how to spot", "example of a phishing", "training module", "security bulletin", "awareness training",
)
CONTEXT_SENSITIVE_TERMS = (
    "verify your account", "verify your identity", "confirm your identity", "confirm your account", "reset your password", "account suspended", "account locked", "click here", "login", "log in", "sign in", "signin",
    "password", "credentials", "unusual activity", "suspicious activity", "verify", "authenticate",
)
# Sizes at which exporters end a page, and clients that a user agent may name, in the order in which they are tried.
PAGE_CAPS = (500, 999, 1000, 5000, 10000)
AGENT_TOKENS = ("python-requests", "curl", "Go-http-client", "axios", "PowerShell", "okhttp", "Chrome", "Firefox", "Safari", "Edg", "Electron", "Mobile")


# Fixed values.
@dataclass(frozen=True)
class Thresholds:
    tier1: int = 12
    domain_min: int = 3
    established_min: int = 5
    enforce_min: int = 3
    enforce_share: float = 0.5
    internal_sender_min: int = 2
    internal_recipient_min: int = 3
    dominant_share: float = 0.6
    phrase_cap: float = 0.05
    rule_keyword_cap: float = 0.25
    campaign_threshold: float = 0.38
    weak_bucket: int = 0  # no cap: with 80 and 400, links of larger keys are lost
    strong_bucket: int = 0
    boiler_count: int = 5
    boiler_senders: int = 3
    boiler_days: float = 7.0
    burst_count: int = 8
    burst_hours: float = 72.0


DEFAULTS = Thresholds()


def load(path: str) -> Thresholds:
    """The thresholds with what a JSON file says in their place, at any depth; unknown names are refused."""
    import json

    def flat(x: dict) -> dict:
        return {k: v for a, b in x.items() for k, v in (flat(b) if isinstance(b, dict) else {a: b}).items()}

    with open(path, encoding="utf-8") as f:
        said = flat(json.load(f))
    known = {n: type(getattr(DEFAULTS, n)) for n in DEFAULTS.__dataclass_fields__}
    if wrong := sorted(set(said) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(wrong)}")
    return replace(DEFAULTS, **{k: known[k](v) for k, v in said.items()})
