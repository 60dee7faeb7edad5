import hashlib
import re

import pytest

from pagemart.llm import pii

from .conftest import rows_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in text.split(".")),
        "card": 12 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def expected(text):
    found = [
        (m.start(), i, f"{kind}:{m.start()}:{m.end()}")
        for i, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text)
        if valid(kind, m[0])
    ]
    return ",".join(s for *_, s in sorted(found))


TEXTS = [
    "",
    "mail a.b+c@d-e.example.com, or x@y, @z.com, a@b.c@d.ef",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 0000 0000 0000, 12",
    "+1 (514) 555-0123 +49 30 1234567 +1 2 +12345678901234567890 ++1 234 567 890",
    "é@é a@b.com é1.1.1.1é 日本 +44 20 7946 0958",
    "1" * 6000 + "." + "0" * 5000 + "1.2.3",
    "a" * 5000 + "@" + "b" * 5000 + ".c",
    "1-2 3-4 5-6 7-8 9-0 1-2 3",
    "5555-5555 5555 4444 x@1.2.3.4 +1.2.3.4.5.6.7.8.9",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_the_patterns(text):
    found = pii.find_spans(text, pii.automaton())
    assert pii.span_list([s for s in found if s[2] in pii.BASE_KINDS]) == expected(text)


def test_random_texts_equal_the_patterns():
    import random

    draw = random.Random(3)
    anchors = pii.automaton()
    for _ in range(3000):
        text = "".join(draw.choice("aA1234567890@.+-() \né") for _ in range(draw.randint(0, 60)))
        found = [s for s in pii.find_spans(text, anchors) if s[2] in pii.BASE_KINDS]
        assert pii.span_list(found) == expected(text), text


def test_added_kinds():
    text = (
        'see https://shop.example/a?b=1, www.shop.example. IBAN: DE89 3704 0044 0532 0130 00 '
        'IBAN DE89 3704 0044 0532 0130 01 token = "04dbebab91ab85687d33eeaa" password: hello awww.x.y'
    )
    found = [(k, text[a:b]) for a, b, k in pii.find_spans(text, pii.automaton()) if k not in pii.BASE_KINDS]
    assert found == [
        ("url", "https://shop.example/a?b=1"[:26]),
        ("url", "www.shop.example"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("account", "04dbebab91ab85687d33eeaa"),
    ]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("ssn: 123-45-6789", "123-45-6789"),
        ("SSN 123456789.", "123456789"),
        ("His ssn is 123 45 6789, he said", "123 45 6789"),
        ('"ssn": "123-45-6789"', "123-45-6789"),
        ("passport: X1234567", "X1234567"),
        ("Passport No. 912345678", "912345678"),
        ("account: 12345678", "12345678"),
        ("account number: 4012888812345", "4012888812345"),
        ("account no. 123456789012", "123456789012"),
        ("account_number=1234 5678 9012 34", "1234 5678 9012 34"),
        ("secret key is 04dbebab91ab85687d33", "04dbebab91ab85687d33"),
        ("ssn: 04dbebab91ab85687d33eeaa", "04dbebab91ab85687d33eeaa"),
        ("ssn: 000-12-3456", None),
        ("ssn: 123-45-678", None),
        ("ssn 12345678", None),
        ("passport renewed in 2019", None),
        ("passport 12345", None),
        ("account 2024-01-15 closed", None),
        ("account 12345", None),
        ("password: 12345678", None),
    ],
)
def test_value_of_each_cue(text, value):
    found = [text[a:b] for a, b, k in pii.find_spans(text, pii.automaton()) if k == "account"]
    assert found == ([value] if value else [])


def test_query_columns(documents, clashing, awkward, no_documents):
    found = pii.span_digest(pii.find_personal_data(documents)).collect()
    assert len(found) == len(awkward)
    texts = {r[0]: r[1] or "" for r in awkward if r[0] is not None}
    for row in found:
        if row["doc_id"] is not None:
            want = expected(texts[row["doc_id"]])
            assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert row["n_ip"] == want.count("ip:") and row["n_card"] == want.count("card:")
    again = pii.span_digest(pii.find_personal_data(clashing))
    assert rows_of(again) == sorted(tuple(map(repr, r)) for r in found)
    assert pii.span_digest(pii.find_personal_data(no_documents)).count() == 0
