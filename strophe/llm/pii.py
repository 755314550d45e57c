"""PII: format-preserving Feistel pseudonyms.

Validated values (payment cards by Luhn, IBANs by mod 97, US social security and phone numbers, numbers with a country's
code, IP addresses of both versions, calendar dates in digits or with month names of four languages, mail addresses) are
ranked inside the set of values of their kind, and the rank goes through a keyed Feistel permutation of that set with
cycle walking. The result has the same format and passes the same validation; equal values get equal pseudonyms in every
document, however they are written, and a holder of the key can invert each value. Days up to the 12th and later days are
two sets, so that a pseudonym can be read in only the way that its value was: month first where there is no such day
first, day first else. Phone numbers of the North American plan become such numbers; other numbers written like one
become numbers outside the plan; a country's code stays. Numbers that fail validation stay as they are. A date without
leading zeros whose pseudonym shows none is inverted with leading zeros, an IPv6 address to its short form. Where the longest match of a card or an IBAN fails, because a number or capitals stand
beside it, its parts are tried: shorter ends and later starts at the groups' edges, a card by its issuer's lengths, an
IBAN by its country's length.

Defined results: null text stays null, empty stays empty; null ids, repeated rows and all other columns stay as they
are; an empty table stays empty. Texts are read whole. The key is the caller's: whoever has it can invert every value.
"""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date
from hashlib import blake2b
from ipaddress import AddressValueError, IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def days_of(year: int, month: int) -> list[date]:
    return [date(year, month, d + 1) for d in range(monthrange(year, month)[1])]


ROUNDS = 8
KINDS = ("date", "card", "iban", "ssn", "phone", "ip", "mail")
COUNTED_AS = {"ymd": "date", "dmy": "date", "abroad": "phone", "ip6": "ip"}
YEARS = range(1900, 2100)
#: The days that can be taken for a month, and the others, in order.
DAYS = {early: [d for y in YEARS for m in range(1, 13) for d in days_of(y, m) if (d.day <= 12) == early] for early in (True, False)}
PLACES = {early: {d: i for i, d in enumerate(found)} for early, found in DAYS.items()}
#: ASCII letters and any digits bound a value; letters of other scripts need no space beside it.
BEFORE, AFTER = r"(?<![A-Za-z_.@+-])(?<!\d)", r"(?![A-Za-z_@]|\d|[.-]\d)"
CARD = r"\d(?:[ -]?\d){12,18}(?![A-Za-z_@]|\d|\.\d)"
NUMBER = re.compile(
    BEFORE + r"(?:"
    r"(?P<ymd>\d{4}([-/.])\d{2}\2\d{2}(?:(?=T\d\d)|" + AFTER + r"))"
    r"|(?:"
    r"(?P<dmy>\d{1,2}([-/.])\d{1,2}\4\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<phone>(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?:\+1[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}|\+1\d{10})"
    r"|(?P<abroad>\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,})){1,6})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]){11,30})"
    r")" + AFTER + r"|(?P<card>" + CARD + r"))"
)
INNER_CARD = re.compile(CARD)
#: Characters of an IBAN by country (the registry's).
IBAN_LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV NI",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
IBAN_LENGTH = {code: n for n, codes in IBAN_LENGTHS.items() for code in codes}
#: Month names by language, and the English short ones. Fixed values.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
}
MONTH = {language: {name.lower(): i + 1 for i, name in enumerate(names)} for language, names in MONTHS.items()}
NAMES = "|".join(sorted({name for names in MONTHS.values() for name in names}, key=len, reverse=True))
WRITTEN = re.compile(
    rf"(?<![^\W_])(?:(?P<m1>{NAMES})(?P<s1>\.?\x20)(?P<d1>\d{{1,2}})(?P<o1>st|nd|rd|th)?(?P<t1>,?\x20)"
    rf"|(?P<d2>\d{{1,2}})(?P<o2>st|nd|rd|th|er)?(?P<s2>\.?\x20(?:de\x20|of\x20)?)(?P<m2>{NAMES})(?P<t2>[.,]?\x20(?:de\x20)?))(?P<y>\d{{4}})(?![^\W_])",
    re.I,
)
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.\d)")
#: Country calling codes of two digits (1 and 7 have one digit, all others three). Fixed values.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
MAIL = re.compile(r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9_-])")


def permute(x: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size): Feistel over an a x b grid that holds it, walking until the value is inside."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def noise(round_: int, half: int, modulus: int) -> int:
        h = blake2b(f"{kind}|{size}|{round_}|{half}".encode(), key=key, digest_size=16)
        return int.from_bytes(h.digest(), "little") % modulus

    while True:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * noise(r, left, b)) % b
            else:
                left = (left + sign * noise(r, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def luhn_digit(digits: str) -> str:
    """The check digit that completes these digits."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def mixed(chars: str) -> tuple[int, int]:
    """Rank and number of all strings with the same character classes at the same places."""
    rank, size = 0, 1
    for c in chars:
        base, zero = (10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A") if c.isupper() else (1, c)
        rank, size = rank * base + ord(c) - ord(zero), size * base
    return rank, size


def unmixed(rank: int, shape: str) -> str:
    out = []
    for c in reversed(shape):
        base, zero = (10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A") if c.isupper() else (1, c)
        rank, digit = divmod(rank, base)
        out.append(chr(ord(zero) + digit))
    return "".join(reversed(out))


def a_date(text: str, at: tuple[int, int, int]) -> date | None:
    parts = re.split(r"[-/.]", text)
    try:
        day = date(*(int(parts[i]) for i in at))
    except ValueError:
        return None
    return day if day.year in YEARS else None


def other_day(day: date, key: bytes, back: bool = False) -> date:
    """The pseudonym of a day, the same in all formats: one of the days up to the 12th for such a day, a later one for a later."""
    early = day.day <= 12
    return DAYS[early][permute(PLACES[early][day], len(DAYS[early]), key, f"date{early}", back)]


def written_date(m: re.Match, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a date with a month's name, in its language and order."""
    k = "1" if m["m1"] else "2"
    name, digits, ordinal = m[f"m{k}"], m[f"d{k}"], m[f"o{k}"] or ""
    languages = ["de"] * (k == "2" and m["s2"].startswith(".")) + ["en", "de", "fr", "es", "short"]
    language = next(x for x in languages if name.lower() in MONTH[x])
    try:
        day = date(int(m["y"]), MONTH[language][name.lower()], int(digits))
    except ValueError:
        return None
    if day.year not in YEARS:
        return None
    new = other_day(day, key, back)
    named = MONTHS[language][new.month - 1]
    named = named.lower() if name.islower() else named.upper() if name.isupper() else named[0].upper() + named[1:]
    if ordinal.lower() in ("st", "nd", "rd", "th"):
        ordinal = "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    elif ordinal:
        ordinal = "er" if new.day == 1 else ""
    number = f"{new.day:02d}" if digits.startswith("0") else f"{new.day}"
    return f"{named}{m['s1']}{number}{ordinal}{m['t1']}{new.year:04d}" if k == "1" else f"{number}{ordinal}{m['s2']}{named}{m['t2']}{new.year:04d}"


def dialled(digits: str) -> bool:
    """Whether ten digits are a number of the North American plan: area and exchange start with 2 to 9 and do not end in 11."""
    return all(d[0] > "1" and d[1:] != "11" for d in (digits[:3], digits[3:6]))


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym, or None when it fails the kind's validation."""
    digits = "".join(c for c in value if c.isdigit())
    if kind in ("ymd", "dmy"):
        # day first where that is a date; month first is left for days over 12, whose pseudonyms are over 12 too
        for at in ((0, 1, 2),) if kind == "ymd" else ((2, 1, 0), (2, 0, 1)):
            if day := a_date(value, at):
                new = other_day(day, key, back)
                own = re.split(r"[-/.]", value)
                wide = 2 if all(len(f) > 1 for f in own) else 1
                fields = {at[0]: f"{new.year:04d}", at[1]: f"{new.month:0{wide}d}", at[2]: f"{new.day:0{wide}d}"}
                return next(c for c in value if not c.isdigit()).join(fields[i] for i in range(3))
        return None
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, 'card', back):0{len(digits) - 1}d}"
        return refill(value, body + luhn_digit(body))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rank, serial = divmod(permute(rank, 898 * 99 * 9999, key, "ssn", back), 9999)
        area, group = divmod(rank, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        own = digits[-10:]
        new = own
        while True:
            new = f"{permute(int(new), 10**10, key, 'phone', back):010d}"
            if dialled(new) == dialled(own):
                return refill(value, digits[:-10] + new)
    if kind == "abroad":
        code = digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]
        own = new = digits[len(code) :]
        if not 8 <= len(digits) <= 15 or len(own) < 6:
            return None
        while True:
            new = f"{permute(int(new), 10 ** len(own), key, f'phone{code}', back):0{len(own)}d}"
            if (new[0] == "0") == (own[0] == "0"):
                return refill(value, code + new)
    if kind == "ip6":
        try:
            address = IPv6Address(value)
        except AddressValueError:
            return None
        if int(address) < 2:  # the unspecified and the loopback address
            return None
        new = str(IPv6Address(permute(int(address), 1 << 128, key, "ip6", back)))
        return new.upper() if value.upper() == value != value.lower() else new
    if kind == "ip":
        octets = [int(p) for p in value.split(".")]
        if max(octets) > 255 or any(p != str(int(p)) for p in value.split(".")):
            return None
        new = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip", back)
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "iban":
        bare = value.replace(" ", "")
        if len(bare) < 15 or int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
            return None
        rank, size = mixed(bare[4:])
        body = unmixed(permute(rank, size, key, f"iban{bare[:2]}", back), bare[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{bare[:2]}00")) % 97
        it = iter(f"{bare[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in value)
    local, _, domain = value.partition("@")
    rank, size = mixed(local)
    shape = "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in local)
    return f"{unmixed(permute(rank, size, key, f'mail{shape}@{domain.lower()}', back), local)}@{domain}"


def issued(digits: str) -> bool:
    """Whether card issuers use this length with this start."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    if two // 10 == 4:
        return n in (13, 16, 19)
    if two in (34, 37):
        return n == 15
    if two in (30, 36, 38, 39):
        return n >= 14
    if two == 35 or 2200 <= four <= 2204:
        return n >= 16
    if 51 <= two <= 55 or 2221 <= four <= 2720:
        return n == 16
    return two in (50, 56, 57, 58) or two // 10 == 6


def ends(kind: str, value: str, inner: bool) -> list[int]:
    """Where a value may end in this match: the whole first, but an IBAN's country tells its length; then shorter ones at a group's edge."""
    found = [len(value)]
    edges = [i for i in range(len(value) - 1, 0, -1) if value[i] in " -"]
    if kind == "card":
        found += [i for i in edges if sum(c.isdigit() for c in value[:i]) >= 13]
        found = [i for i in found if (i == len(value) and not inner) or issued("".join(c for c in value[:i] if c.isdigit()))]
    elif kind == "iban":
        sizes = {i: len(value[:i].replace(" ", "")) for i in [*found, *edges]}
        fixed = IBAN_LENGTH.get(value[:2])
        found = [i for i, n in sizes.items() if n == fixed] + found if fixed else found + [i for i in edges if sizes[i] >= 15]
    return found


def replace_all(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind."""
    counts: dict[str, int] = {}

    def swap(kind: str, value: str) -> str | None:
        new = pseudonym(kind, value, key, back)
        if new is None:
            return None
        name = COUNTED_AS.get(kind, kind)
        counts[name] = counts.get(name, 0) + 1
        return new

    def swap_written(m: re.Match) -> str:
        new = written_date(m, key, back)
        if new is None:
            return m[0]
        counts["date"] = counts.get("date", 0) + 1
        return new

    if "@" in text:
        text = MAIL.sub(lambda m: swap("mail", m[0]) or m[0], text)
    if text.count(":") > 1:
        text = IPV6.sub(lambda m: swap("ip6", m[0]) or m[0], text)
    if any(c in text for c in "0123456789"):
        text = WRITTEN.sub(swap_written, text)
        out, done, pos, inner = [], 0, 0, False
        while True:
            m = INNER_CARD.match(text, pos) if inner else None
            inner = m is not None
            m = m or NUMBER.search(text, pos)
            if m is None:
                break
            kind = m.lastgroup or "card"
            # a run of more groups than a card has is searched like one that failed
            inner = inner or (kind == "card" and text.startswith("-", m.end()) and text[m.end() + 1 : m.end() + 2].isdigit())
            for end in ends(kind, m[0], inner):
                value = m[0][:end]
                new = swap(kind, value)
                if new is not None:
                    out += [text[done : m.start()], new]
                    done = pos = m.start() + end
                    # what follows a card in its own run may start right after a hyphen
                    pos += kind == "card" and end < len(m[0])
                    inner = pos > done
                    break
            else:
                edge = re.search("[ -]", m[0]) if kind in ("card", "iban") else None
                pos, inner = (m.start() + edge.end(), kind == "card") if edge else (m.end(), False)
        text = "".join([*out, text[done:]])
    return text, counts


def replaced(docs: DataFrame, key: str, text_col: str, added: dict[str, str]) -> DataFrame:
    """All columns, the text with pseudonyms, and for each kind in `added` a column of that name with how many of its values were replaced."""
    secret, names = key.encode()[:64], docs.columns

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(text_col).to_pylist():
                new, n = replace_all(t, secret) if t else (t, {})
                texts.append(new)
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([n.get(k, 0) for n in counts], pa.int64()) for k in added)], names=[*names, *added.values()])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in added.values())]))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns, the text with pseudonyms, and n_date, n_card, ... with how many values of each kind were replaced. An input column named like one of these is replaced."""
    added = {k: f"n_{k}" for k in KINDS}
    kept = [c for c in docs.columns if c.lower() not in added.values()]
    return replaced(docs.select(*[f"`{c}`" for c in kept]), key, text_col, added)


def pseudonymise_text(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The same columns, whatever their names; only the text changes."""
    return replaced(docs, key, text_col, {})
