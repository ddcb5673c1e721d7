"""Personal data against the plain patterns of the contract, and on texts that defeat patterns
which start again at every character."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from movelines.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(d):
    odd, even = d[::-1][::2], d[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0


CHECK = {
    "email": lambda x: True,
    "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
    "card": lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x)),
    "phone": lambda x: 10 <= len(digits(x)) <= 15,
}


def plain(text):
    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if CHECK[k](m.group())]
    return sorted(found, key=lambda x: (x[1], pii.BASE_KINDS.index(x[0])))


PIECES = ["a", "b.c", "@", "@@", "x@y.z", ".", "-", " ", "+", "%", "1", "12", "255", "256", "1.2.3.4", "..", "(", ")", "é", "\n", "+49 30 123456", "4111 1111 1111 1111", "4111111111111111", "0" * 15, "123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "tel", "card"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_base_kinds_are_the_plain_patterns(text):
    found = pii.find(text)
    assert [x[:3] for x in found if x[0] in pii.BASE_KINDS] == plain(text)
    added = [(s, e) for k, s, e, _ in found if k not in pii.BASE_KINDS]
    others = [(s, e) for k, s, e in plain(text)]
    for n, (s, e) in enumerate(added):  # an added span overlaps nothing
        assert all(e <= a or b <= s for a, b in others + added[:n])


N = 1_000_000


@pytest.mark.parametrize("text", ["1" * N, "a" * N + "@b", "a" * N + "@b.c", "@" * N, "a@" * (N // 2), "1." * (N // 2), "1.2.3.4 " * (N // 8), "+1" * (N // 2), "+1" + "(" * N, "1 " * (N // 2), "A1" * (N // 2), "DE89 " * (N // 5)], ids=range(12))
def test_time_grows_with_the_text_only(text):
    began = time.process_time()
    pii.find(text[: N // 10])
    tenth = time.process_time() - began
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < max(2.0, 25 * tenth)


def test_long_texts_keep_their_spans():
    found = pii.find("a" * 100_000 + "@b.org and " + "7" * 100_000 + " 1.2.3.4")
    assert [(k, e - s) for k, s, e, _ in found] == [("email", 100_006), ("ip", 7)]
