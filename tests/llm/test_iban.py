"""Bank account numbers of every country of the registry."""

import pytest

from movelines.llm import pii

KNOWN = [
    "GR16 0110 1250 0000 0001 2300 695",
    "HU42 1177 3016 1111 1018 0000 0000",
    "RO49 AAAA 1B31 0075 9384 0000",
    "BG80 BNBG 9661 1020 3456 78",
    "HR12 1001 0051 8630 0016 0",
    "MC58 1122 2000 0101 2345 6789 030",
    "LI21 0881 0000 2324 013A A",
    "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
    "TR33 0006 1005 1978 6457 8413 26",
    "SA03 8000 0000 6080 1016 7519",
    "AE07 0331 2345 6789 0123 456",
    "LC55 HEMM 0001 0001 0012 0012 0002 3015",
    "NO93 8601 1117 947",
    "DE89 3704 0044 0532 0130 00",
]


def account(country, rest):
    """With its check digits."""
    digits = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    return f"{country}{digits:02}{rest}"


@pytest.mark.parametrize("number", KNOWN)
def test_printed_and_plain(number):
    for x in (number, number.replace(" ", "")):
        for text in (f"pay {x}, today", f"pay {x} NOW AND HERE", x):
            assert [(k, text[s:e]) for k, s, e in pii._added(text) if k == "iban"] == [("iban", x)]
        assert not any(k == "iban" for k, *_ in pii._added(f"pay {x[:-1]}{(int(x[-1], 36) + 1) % 10}, today"))


def test_every_country_has_its_length():
    assert len(pii.IBAN_LENGTHS) >= 80
    for country, size in pii.IBAN_LENGTHS.items():
        right, long = (account(country, "1" * (n - 4)) for n in (size, size + 1))
        assert ("iban", 0, size) in pii._added(right)
        assert "iban" not in [k for k, *_ in pii._added(f"IBAN {long}")]


def test_unknown_country_needs_a_word():
    for size in (15, 22, 34):
        x = account("ZZ", "7" * (size - 4))
        assert "iban" not in [k for k, *_ in pii._added(f"code {x} it is")]
        assert ("iban", 5, 5 + size) in pii._added(f"IBAN {x} NOW")
    assert "iban" not in [k for k, *_ in pii.find("IBAN " + account("ZZ", "7" * 10))]


def test_one_after_the_other():
    text = "AT61 1904 3002 3457 3201 BE68 5390 0754 7034 AB12 3456 7890 ES91 2100 0418 4502 0005 1332"
    assert pii.redact(text, pii.find(text)) == "[IBAN] [IBAN] AB12 3456 7890 [IBAN]"
