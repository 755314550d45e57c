"""Values with a number, capitals or letters of other scripts beside them."""

import pytest

from strophe.llm import pii

KEY = b"k"
CARD, IBAN = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize(
    "before, value, after",
    [
        ("", CARD, " 123"),
        ("", "4111111111111111", " 12"),
        ("pay ", CARD, " 12/26"),
        ("5 ", "4111111111111111", ""),
        ("1234 ", CARD, " 99"),
        ("7-", "4111-1111-1111-1111", "-123"),
        ("", "DE89370400440532013000", " BIC"),
        ("", IBAN, " OR CASH"),
        ("AB12 ", IBAN, ""),
        ("卡号", CARD, "谢谢"),
        ("电话", "555-123-4567", "。"),
        ("写给", "some.name@mail.org", "吧"),
        ("at ", "1990-05-17", "T10:00:00Z"),
    ],
)
def test_value_with_neighbours(before, value, after):
    new, counts = pii.replace_all(before + value + after, KEY)
    assert value not in new and sum(counts.values()) == 1
    kind = next(iter(counts))
    want = pii.pseudonym("ymd" if kind == "date" else kind, value, KEY)
    assert new == before + want + after


def test_numbers_that_are_no_values_stay():
    for text in ("1234 5678 9012 3456 78", "AB12 CDEF GHIJ KLMN", "x4111111111111111", "4111111111111111x", "10 20 30 40 50 60 70 80 90"):
        assert pii.replace_all(text, KEY) == (text, {})


def test_both_of_two_neighbours():
    new, counts = pii.replace_all(f"{CARD} 123 {CARD} DE89370400440532013000 {IBAN}", KEY)
    assert counts == {"card": 2, "iban": 2} and CARD not in new
