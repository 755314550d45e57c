"""Normalisation for alignment rule by rule, in plain loops."""

import random
import re
import unicodedata

import pytest

from strophe.functions import rewrite
from strophe.queries import verses

DIR = "/root/testdata/sf0.001"
COMMON = [rewrite.BASIC, rewrite.QUOTES, rewrite.SIGNS, rewrite.ARMENIAN, rewrite.CHINESE, rewrite.OTHERS]
LANGUAGES = {"eng": ("", "", False), "ara": ("", "", False), "heb": ("05B0-05CF", "", False), "mon": ("00AD", "", False), "tha": ("", "200D", False), "jav": ("", "", True)}


def within(c, codes):
    return any(int(a, 16) <= ord(c) <= int(b or a, 16) for a, _, b in (x.partition("-") for x in codes.split()))


def replaced(text, old, new):
    return new.join(text.split(old))


def plain(text, language):
    gone, more, bare = LANGUAGES[language]
    text = unicodedata.normalize("NFKC", text).lower()
    out, at = "", 0
    while at < len(text):  # brackets that hold a digit
        end = text.find(")", at) if text[at] == "(" else -1
        if end >= 0 and any(c.isdecimal() for c in text[at:end]):
            out, at = out + " ", end + 1
        else:
            out, at = out + text[at], at + 1
    text, out, at = out, "", 0
    while at < len(text):
        old = next((k for k in sorted(rewrite.MAPPED, key=len, reverse=True) if text.startswith(k, at)), None)
        out, at = out + (rewrite.MAPPED[old] if old else text[at]), at + (len(old) if old else 1)
    runs = re.split(r"(\s+)", out)
    for i, run in enumerate(runs):
        places = [k for k, c in enumerate(run) if c in "‘’‛" and 0 < k < len(run) - 1]
        if places:
            runs[i] = run[: places[-1]] + "'" + run[places[-1] + 1 :]
    text = "".join(" " if any(within(c, x) for x in (*COMMON, more)) else "" if within(c, f"{rewrite.DELETED} {gone}") else c for c in "".join(runs))
    words = re.split(r"(\s+)", text)
    if len(words) > 1:
        words = [" " if w and all(within(c, rewrite.DIGITS) for c in w) else w for w in words]
    text = "".join(words)
    if bare:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text).strip()


@pytest.mark.parametrize("language", LANGUAGES)
def test_rule_by_rule(language):
    rng = random.Random(language)
    pieces = [*"abcÀéИק0123 \n'’‘‛.,;:!?()[]-ٱ٣०­ְ‍ًﬁ½Ⅷ①", "&lt;", "&gt;", "&nbsp;", "(Sam 23:17)", "(x)", " 12 ", "don’t", "rock’n’roll", "&l&lt;t;"]
    for _ in range(250):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert rewrite.normalizer_of(language)(text) == plain(text, language), repr(text)


@pytest.mark.parametrize(
    "text, want",
    [("Don’t stop (Sam 23:17), now.", "don't stop now"), ("In 1999 he won 3 times 5", "in he won times"), ("1999", "1999"), ("(no digits) stay", "no digits stay"), ("ＡＢＣ　ﬁn", "abc fin"), ("", "")],
)
def test_examples(text, want):
    assert rewrite.normalizer_of("eng")(text) == want


def test_longest_rule_first():
    rng = random.Random(1)
    for _ in range(200):
        rules = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): rng.choice(["", "x", "aa"]) for _ in range(rng.randrange(1, 7))}
        text = "".join(rng.choice("abc") for _ in range(40))
        out, at = "", 0
        while at < len(text):
            old = next((k for k in sorted(rules, key=len, reverse=True) if text.startswith(k, at)), None)
            out, at = out + (rules[old] if old else text[at]), at + (len(old) if old else 1)
        assert rewrite.compiled(rules)(text) == out
    assert rewrite.compiled({})("ab") == "ab"
    with pytest.raises(ValueError, match="needs a string"):
        rewrite.compiled({"": "x"})


def test_whole_table(spark):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = verses.rewritten_text(spark, DIR).collect()
    assert len(got) == len(given) and {r["language"] for r in got} == {"eng", "ara", "heb", "mon"}
    for r in got:
        text = given[r["doc_id"]]
        assert r["normal"] == (None if text is None else plain(text, r["language"]))
