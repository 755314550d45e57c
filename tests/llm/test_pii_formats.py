"""One pseudonym for one day in every format; written dates, numbers abroad, IPv6; an independent finder over the whole table."""

import calendar
import re
from datetime import date, timedelta

import duckdb
import pytest

from strophe.llm import pii

KEY = b"k"


def day_of(text, order):
    parts = [int(x) for x in re.findall(r"\d+", text)]
    return date(**{k: parts[i] for i, k in enumerate(order)})


def test_a_day_has_one_pseudonym_in_all_formats():
    """All days of ten years in every numeric and written format."""
    day, new_days = date(2015, 1, 1), set()
    while day < date(2025, 1, 1):
        new = pii.other_day(day, KEY)
        assert pii.other_day(new, KEY, back=True) == day and (new.day > 12) == (day.day > 12)
        new_days.add(new)
        y, m, d = day.year, day.month, day.day
        shapes = [(f"{y}-{m:02d}-{d:02d}", "ymd"), (f"{d:02d}.{m:02d}.{y}", "dmy"), (f"{d}/{m}/{y}", "dmy")]
        if d > 12:
            shapes += [(f"{m:02d}/{d:02d}/{y}", "mdy"), (f"{m}-{d}-{y}", "mdy")]
        for text, order in shapes:
            got, counts = pii.replace_all(f"on {text}, so", KEY)
            at = {"y": "year", "m": "month", "d": "day"}
            assert counts == {"date": 1} and day_of(got, [at[c] for c in order]) == new, text
            assert day_of(pii.replace_all(got, KEY, back=True)[0], [at[c] for c in order]) == day
        for language, name in (("en", calendar.month_name[m]), ("short", calendar.month_abbr[m])):
            got, _ = pii.replace_all(f"on {name} {d}, {y}.", KEY)
            found = re.fullmatch(r"on (\w+) (\d+), (\d+)\.", got)
            assert date(int(found[3]), pii.MONTH[language if language == "en" or m != 5 else "en"][found[1].lower()], int(found[2])) == new
        day += timedelta(1)
    assert len(new_days) == 3_653


@pytest.mark.parametrize("text", ["25. Dezember 2020", "25 décembre 2020", "1er mars 2019", "25 de diciembre de 2020", "3rd of June 2001", "JUNE 3rd, 2001", "4 juillet 1999", "05 mayo 2010", "Sep. 9, 1999", "7. März 1985"])
def test_written_dates(text):
    new, counts = pii.replace_all(f"am {text} war", KEY)
    assert counts == {"date": 1} and text not in new
    assert re.sub(r"\d+|[^\W\d_]+", "", new) == re.sub(r"\d+|[^\W\d_]+", "", f"am {text} war")
    assert [w for w in ("de", "of") if f" {w} " in new] == [w for w in ("de", "of") if f" {w} " in text]


@pytest.mark.parametrize("text", ["32. Dezember 2020", "Smarch 3, 2020", "31 juin 2020", "May 2020", "3 May 20201", "12:34:56", "::1", "::", "1:2:3", "+49 30", "+0 123456789", "30/30/2020", "3/7/20211"])
def test_what_is_no_value_stays(text):
    assert pii.replace_all(f"so {text} it", KEY) == (f"so {text} it", {})


@pytest.mark.parametrize("text, kind", [("+49 30 901820", "phone"), ("+442071838750", "phone"), ("+351 21 123 45 67", "phone"), ("2001:db8::1", "ip"), ("2001:0DB8:0:0:0:0:0:1", "ip"), ("fe80::1234:5678:9abc:def0", "ip")])
def test_numbers_abroad_and_addresses(text, kind):
    new, counts = pii.replace_all(f"at {text} now", KEY)
    assert counts == {kind: 1} and text not in new
    value = new.removeprefix("at ").removesuffix(" now")
    if kind == "phone":
        code = {"4": 3, "3": 4}[text[1]]
        assert value[:code] == text[:code] and re.sub(r"\d", "0", value) == re.sub(r"\d", "0", text)
        assert pii.replace_all(new, KEY, back=True)[0] == f"at {text} now"
    else:
        assert pii.IPv6Address(pii.pseudonym("ip6", value, KEY, back=True)) == pii.IPv6Address(text)


def test_links_across_writings():
    def of(text):
        return re.sub(r"\D", "", pii.replace_all(text, KEY)[0])

    assert of("+49 30 901820") == of("+4930901820") == of("+49 (30) 90-18-20")
    assert pii.pseudonym("ip6", "2001:db8::1", KEY) == pii.pseudonym("ip6", "2001:0db8:0:0:0:0:0:1", KEY)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_an_independent_finder_over_the_whole_table():
    """Words that are addresses, cards or phone numbers by plain rules: as many are counted, and none is left where it stood."""
    with duckdb.connect() as db:
        texts = [t for (t,) in db.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    total = dict.fromkeys(("mail", "ip", "card", "phone", "date"), 0)
    for text in texts:
        words = [w.strip("!%$#*&\"'.,;()") for w in text.split()]
        of = {
            "mail": [w for w in words if re.fullmatch(r"[\w.]+@\w+(\.\w+)+", w)],
            "ip": [w for w in words if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", w) and all(int(x) < 256 and x == str(int(x)) for x in w.split("."))],
            "card": [w for w in words if re.fullmatch(r"\d{16}", w) and luhn(w)],
            "phone": re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text),
            "date": [],
        }
        new, counts = pii.replace_all(text, KEY)
        for kind, values in of.items():
            total[kind] += len(values)
            assert counts.get(kind, 0) == len(values), (kind, values)
            assert not [v for v in values if v in new]
        assert pii.replace_all(new, KEY, back=True)[0] == text
    assert all(total[k] > 50 for k in ("mail", "ip", "card", "phone"))
