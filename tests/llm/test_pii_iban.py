import pytest

from caseweave.llm import pii


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"])
@pytest.mark.parametrize("after", ["", " please", " Please", " 2024", " BIC COBADEFF", ".", " A B C D E F G H I J K L M"])
def test_account_before_capitals_and_digits(iban, after):
    assert pii.find(f"to {iban}{after}", pii.automaton())["iban"] == [(3, 3 + len(iban))]


@pytest.mark.parametrize("text", ["DE88370400440532013000 Please", "DE89370400440532013000x", "XDE89370400440532013000 2024"])
def test_no_account(text):
    assert pii.find(text, pii.automaton())["iban"] == []
