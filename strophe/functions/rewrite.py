"""Texts for alignment: Unicode form, rewriting by rules of a language, words of digits, spaces.

Rules map strings to strings. They are compiled to a trie, and the trie to one regular expression that tries longer
rules before their beginnings, so one pass rewrites a text by the longest rule at each place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chars(codes: str) -> list[str]:
    """Characters of code points in hexadecimal, "a-b" for a range."""
    ends = [(x.partition("-")[0], x.rpartition("-")[2]) for x in codes.split()]
    return [chr(c) for a, b in ends for c in range(int(a, 16), int(b, 16) + 1)]


#: Punctuation that becomes a space, by code points. Fixed values.
BASIC = "002E 003F 002C 003A 0021 007B 007D"
QUOTES = "201C 201D 00AB 00BB 2039 203A 201E 201A 201F 201B 2019 2018 0022"
SIGNS = "003E 003C 00BF 003B 00A1 060C 3001 0964 061B 061F"
ARMENIAN = "055A 055B 055C 055D 055E 055F 0589"
CHINESE = "3002 FF0C FF01 FF1F FF1B FF1A FF08 FF09 300C-300F FF41-FF44 3008-300B FE4F 22EF 3001 2027 FF0F FF5E 2500 FF3F"
OTHERS = (
    "0081 0090 0008 008D 0094 008F 001A 009D 0093 0092 E295 F21D F62D F173 E514 E293 F523 E233 F50F E232 EA7B F172 E290 F519 E292 E328 E2FA E234 E043 E040 E2FB E32B E236 F511 E517 E2FE E492 F52D E2FC F521 E516 E041 F529 "
    "E2F9 E2D9 E32A E291 E296 E518 E32C E2DB E231 F522 F518 F513 E32D E32E E06B EA01 E294 E203 F218 E070 E013 E2DE E493 F7E8 F7D0 E313 E329 E06D E003 F50E F171 E01D 206F 2060 2015 05BE 0029 005D 230B 3015 3011 FD3E 0026 "
    "0F0D 1362 1365 0F0C 104B 002F 104A 00B7 2038 002A 06D4 1364 104F 17D4 A4FE 166E A92F 2D70 A4FF 0965 061E 104D 0387 2020 104C 1363 17D6 A92E 203B 1366 2022 00B6 104E FE56 037E 2026 0025 30FB 0F0E 2021 0023 0040 1361 "
    "17DA 17D5 FE50 0F05 0F04 FF0E FE57 FE55 2030 FF65 0028 005B 230A 3014 3010 FD3F 005F 0024 20AC 00A3 007E 003D 007C 2212 226B 226A 002B FF1C FF1E 00AC 00D7 2192 166D 00B0 109F FFFD 231F 231E 00A9 202F 2006 02DC 005E "
    "00AF 02C7 207F 0640 0E46 17D7 3005 0EC6 30FC 2071 09F7 2153 00BD 00BC 215F 2044"
)
#: Characters that go, digits whose words go, and strings that are replaced before both. Fixed values.
DELETED = "200E 200C 0656-0657 200B 064B-0652 202C 200F 202A"
DIGITS = "0030-0039 09E6-09EF 17E0-17E9 0966-096F 0B66-0B6F 06F0-06F9 A900-A909 FF10-FF19 0D66-0D6F 1040-1049 2170-2179 206F"
MAPPED = {"&lt;": "", "&gt;": "", "&nbsp": "", "ٱ": "ا"}
#: What languages add: characters that go, punctuation; languages whose marks go. Fixed values.
ALSO_DELETED = {"mon": "00AD", "khk": "00AD", "heb": "05B0-05CF"}
ALSO_PUNCTUATION = {"tha": "200D"}
WITHOUT_MARKS = {"jav"}
#: The last of these inside a run without spaces, with a character on both sides, is an apostrophe.
APOSTROPHE = re.compile("(\\S+)[‘’‛](\\S+)")
BRACKETED = re.compile(r"\([^)]*\d[^)]*\)")


def compiled(rules: dict[str, str]) -> Callable[[str], str]:
    """A function that replaces, from left to right, the longest rule's string at each place."""
    if not rules:
        return lambda text: text
    if "" in rules:
        raise ValueError("a rule needs a string")
    trie: dict = {}
    for source in rules:
        node = trie
        for c in source:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        single = [c for c, below in node.items() if c and set(below) == {""}]
        longer = [re.escape(c) + pattern(below) for c, below in sorted(node.items()) if c and set(below) != {""}]
        if single:
            longer.append("[" + "".join(map(re.escape, sorted(single))) + "]")
        body = longer[0] if len(longer) == 1 and "" not in node else "(?:" + "|".join(longer) + ")"
        return body + ("?" if "" in node else "")

    found = re.compile(pattern(trie))
    return lambda text: found.sub(lambda m: rules[m[0]], text)


@lru_cache(maxsize=64)
def normalizer_of(language: str) -> Callable[[str], str]:
    """The normalisation for a language's code; unknown codes have the common rules."""
    first = compiled(MAPPED)
    punctuation = chars(" ".join((BASIC, QUOTES, SIGNS, ARMENIAN, CHINESE, OTHERS, ALSO_PUNCTUATION.get(language, ""))))
    deleted = chars(f"{DELETED} {ALSO_DELETED.get(language, '')}")
    second = compiled(dict.fromkeys(deleted, "") | dict.fromkeys(punctuation, " "))
    digits = f"[{''.join(chars(DIGITS))}]+"
    numbers = re.compile(rf"^{digits}(?=\s)|(?<=\s){digits}(?=\s)|(?<=\s){digits}$")

    def apply(text: str) -> str:
        text = unicodedata.normalize("NFKC", text).lower()
        text = BRACKETED.sub(" ", text)
        text = APOSTROPHE.sub(r"\1'\2", first(text))
        text = numbers.sub(" ", second(text))
        if language in WITHOUT_MARKS:
            text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
        return " ".join(text.split())

    return apply


@F.pandas_udf(T.StringType())
def normalize_text(text: pd.Series, language: pd.Series) -> pd.Series:
    """Texts normalised for alignment by their language's code; null stays null, a null language has the common rules."""
    return pd.Series([None if t is None else normalizer_of(lang or "")(t) for t, lang in zip(text, language, strict=True)], dtype=object)
