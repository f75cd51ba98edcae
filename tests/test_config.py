"""Fixed values, written out once more by hand."""

import json

import pytest

from caseweave import config as C
from caseweave.operators import identity


def test_codes_and_words():
    assert set(C.MFA_GATE_CODES) == {"50074", "50076", "500121", "50079", "50072"}
    assert set(C.BAD_PASSWORD_CODES) == {"50126", "50053", "50055", "50057"}
    assert set(C.STOP_WORDS) == set("the and for this that with from your you are was has have will can please hello thanks thank regards".split())
    assert len(C.NEGATIVE_CONTEXT) == 15 and "training module" in C.NEGATIVE_CONTEXT and "training" not in C.NEGATIVE_CONTEXT
    assert len(C.CONTEXT_SENSITIVE_TERMS) == 18 and "wire transfer" not in C.CONTEXT_SENSITIVE_TERMS
    assert {"mail.read.shared", "mail.readwrite.shared", "mail.send.shared", "mailboxsettings.read"} <= set(identity.MAIL_SCOPES) and len(identity.MAIL_SCOPES) == 14
    assert "sites.read.all" in identity.HIGH_SCOPES and len(identity.HIGH_SCOPES) == 18
    assert len(C.AGENT_TOKENS) == 12 and C.PAGE_CAPS == (500, 999, 1000, 5000, 10000)


def test_load(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"tiers": {"tier1": 15}, "campaign_threshold": 0.5}))
    t = C.load(str(p))
    assert (t.tier1, t.campaign_threshold, t.domain_min) == (15, 0.5, C.DEFAULTS.domain_min)
    p.write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        C.load(str(p))
