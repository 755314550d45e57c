"""Column expressions over text: tokens, cleanup, references, romanised forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verse marks, white space, words (with inner punctuation), any other character: every character is in one token.
TOKEN_PATTERN = r"(\{[0-9]+\}(?:_\{[0-9]+\})*|[\s\p{Z}]+|[\p{L}\p{N}]+(?:[^\s\p{Z}\p{L}\p{N}{][\p{L}\p{N}]+)*|.)"
#: Characters that a cleanup removes or brings to one form. Fixed values.
PROMPT_CHARS = "|*"
PUNCTUATION = ".,:;!?¿¡()[]…"
QUOTES = "“”«»„‟\""
APOSTROPHES = "‘’‛ʼ"
HYPHENS = "‐‑‒–—―"


def blank_if_null(text: Column) -> Column:
    """Missing text is the empty string throughout the dataset tables."""
    return F.coalesce(text, F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(blank_if_null(text), F.lit("(?s)" + TOKEN_PATTERN), F.lit(0))


def token_type(token: Column) -> Column:
    """V verse mark, S space, W word, P any other. ASCII is told by its first character, without a regular expression."""
    c = F.substring(token, 1, 1)
    return (
        F.when(c.between("a", "z") | c.between("A", "Z") | c.between("0", "9"), "W").when(c.isin(" ", "\n", "\t", "\r"), "S").when(c == "{", F.when(F.length(token) > 1, "V").otherwise("P"))
        .when(c < "\x7f", F.when(c.rlike(r"^\s"), "S").otherwise("P")).when(c.rlike(r"^[\p{L}\p{N}]"), "W").when(c.rlike(r"^[\s\p{Z}]"), "S").otherwise("P")
    )


def char_class(chars: str) -> str:
    """A regular expression's class of these characters."""
    return "[" + "".join("\\" + c if c in r"\[]^-|*" else c for c in chars) + "]"


def cleanup(text: Column, prompt_chars: bool = True, punctuation: bool = True, quotes: str = "remove", apostrophes: str = "normalize", hyphens: str = "normalize", lower: bool = True) -> Column:
    """One pass of deletions, then one-to-one replacements; each of the three families is "remove", "normalize" or kept (anything else)."""
    gone = (PROMPT_CHARS if prompt_chars else "") + (PUNCTUATION if punctuation else "")
    gone += "".join(chars for how, chars in ((quotes, QUOTES), (apostrophes, APOSTROPHES + "'"), (hyphens, HYPHENS + "-")) if how == "remove")
    out = F.regexp_replace(text, char_class(gone), "") if gone else text
    for how, chars, to in ((quotes, QUOTES, '"'), (apostrophes, APOSTROPHES, "'"), (hyphens, HYPHENS, "-")):
        if how == "normalize":
            out = F.translate(out, chars, to * len(chars))
    return F.lower(out) if lower else out


def strip_verse_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"\{[0-9\-,]+\}\s?", "")


def verses(text: Column) -> Column:
    """(verse, text) of each "{n} ..." or "{n}_{m} ..." piece of a script line; a joined mark reads "n-m"."""
    mark = r"(\{[0-9]+\}(?:_\{[0-9]+\})*)([^{]*)"
    marks, texts = (F.regexp_extract_all(text, F.lit(mark), F.lit(i)) for i in (1, 2))

    def piece(m, t):
        first, last = F.regexp_extract(m, r"^\{([0-9]+)", 1), F.regexp_extract(m, r"([0-9]+)\}$", 1)
        return F.struct(F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), last)).alias("verse"), F.trim(t).alias("text"))

    return F.zip_with(marks, texts, piece)


def normalize_for_alignment(text: Column) -> Column:
    """Lower case without bracketed numbers, punctuation as spaces, words of digits alone gone, single spaces."""
    out = F.regexp_replace(F.lower(text), r"\([^()]*[0-9][^()]*\)", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\p{M}' ]+", " ")
    out = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(out, " +", "  "), F.lit(" ")), r" [0-9]+ ", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def size_code(code: Column) -> Column:
    """A collection's size as C (complete), N (new part) or O (old part), "" for others."""
    upper = F.upper(code)
    return F.when(upper.startswith("C"), "C").when(upper.startswith("NT"), "N").when(upper.startswith("OT"), "O").otherwise("")


def leading_int(text: Column) -> Column:
    """The number a string starts with, 0 without one ("6a" is 6)."""
    return F.coalesce(F.regexp_extract(text, r"^([0-9]+)", 1).try_cast("int"), F.lit(0))


def zero_fill(text: Column, width: int = 5) -> Column:
    """Leading digits padded to the width, the rest kept ("12r" is "00012r")."""
    digits = F.regexp_extract(text, r"^([0-9]*)", 1)
    return F.concat(F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")), F.regexp_replace(text, r"^[0-9]*", ""))


def verse_range(text: Column) -> tuple[Column, Column]:
    """First and last part of "6-10"; both are the text where there is no range."""
    parts = F.split(text, "-")
    return F.element_at(parts, 1), F.element_at(parts, -1)


def reference(book: Column, chapter: Column, verse: Column, chapter_end: Column, verse_end: Column) -> Column:
    """BBB c:v, BBB c:v-ve, or BBB c:v-ce:ve over a chapter's end."""
    start = F.concat(book, F.lit(" "), chapter, F.lit(":"), verse)
    same = F.when(verse_end.isin("") | (verse_end == verse), start).otherwise(F.concat(start, F.lit("-"), verse_end))
    return F.when(chapter_end.isin(0) | (chapter_end == chapter), same).otherwise(F.concat(start, F.lit("-"), chapter_end, F.lit(":"), verse_end))


def uroman_normalize(text: Column) -> Column:
    """Lower case, plain apostrophes, letters a-z only, no spaces."""
    return F.regexp_replace(F.translate(F.lower(text), "’", "'"), "[^a-z']+", "")


def latin_ratio(text: Column) -> Column:
    """Share of characters up to U+024F; null for an empty text, which then counts as not Latin."""
    latin = F.length(F.regexp_replace(text, "[^\\u0000-\\u024F]", ""))
    return F.when(F.length(text) > 0, latin / F.length(text))


def spelling(word: Column) -> Column:
    """Lexicon line: the word, then its characters apart, "-" as "|", and a closing "|"."""
    chars = F.transform(F.split(word, ""), lambda c: F.when(c == "-", "|").otherwise(c))
    return F.concat(word, F.lit(" "), F.array_join(F.filter(chars, lambda c: c != ""), " "), F.lit(" |"))


def hash_id(*parts: Column) -> Column:
    """First 12 hex digits of the MD5 of the parts."""
    return F.substring(F.md5(F.concat(*parts)), 1, 12)


def replace_suffix(name: Column, suffix: str) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", suffix)


def safe_join(parts: Column) -> Column:
    """Parts joined by single spaces, but none before closing or after opening punctuation."""
    closing, opening = [".", ",", ":", ";", "!", "?", ")", "]", "}", "”", "’"], ["(", "[", "{", "“", "‘", "¿", "¡"]

    def step(acc, p):
        tight = (acc == "") | F.substring(p, 1, 1).isin(*closing) | F.substring(acc, -1, 1).isin(*opening)
        return F.concat(acc, F.when(tight, "").otherwise(" "), p)

    return F.aggregate(F.filter(parts, lambda p: p != ""), F.lit(""), step)


def media_type(name: Column) -> Column:
    """Media type by the file's name."""
    lower = F.lower(name)
    return (
        F.when(lower.endswith(".mp3") | lower.endswith(".wav") | lower.endswith(".opus"), "audio").when(lower.endswith(".usx"), "text_usx_edit")
        .when(lower.endswith(".xlsx"), "text_script").when(lower.endswith(".csv"), "text_csv").when(lower.endswith(".json"), "text_plain").otherwise("")
    )


def v4_name(name: Column) -> dict[str, Column]:
    """Parts of FILESET_BOOK_CHAPTER[_rest].ext names."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "[_-]")
    return {"fileset": F.get(parts, F.lit(0)), "book_id": F.get(parts, F.lit(1)), "chapter": leading_int(F.coalesce(F.get(parts, F.lit(2)), F.lit("")))}


#: Books of both testaments in canonical order. Fixed values.
OT_BOOKS = "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL COV".split()
NT_BOOKS = "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV".split()


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def by_letter(letter: Column) -> Column:
    """The testament that a file name's letter stands for."""
    return F.when(letter == "A", "OT").when(letter == "B", "NT").otherwise("")


def testament_of(book_id: Column) -> Column:
    return F.when(book_id.isin(OT_BOOKS), "OT").when(book_id.isin(NT_BOOKS), "NT").otherwise("")


def v2_name(name: Column) -> dict[str, Column]:
    """Parts of names of fixed width: letter, sequence, chapter, book name and media id, filled up with underscores."""
    base = stem(name)

    def part(first, n):
        return F.trim(F.substring(base, first, n), F.lit("_"))

    return {
        "testament": by_letter(F.substring(base, 1, 1)), "book_seq": part(2, 3), "chapter": part(6, 3).try_cast("int"), "book_name": part(10, 12),
        "media_id": F.substring(base, 22, 1_000),
    }


def v4_audio_name(name: Column) -> dict[str, Column]:
    """Parts of MEDIA_B01_BOOK_chapter_verse_chapterEnd_verseEnd names; "-" divides like "_", and missing parts are '' or 0."""
    parts = F.split(F.replace(stem(name), F.lit("-"), F.lit("_")), "_")

    def part(i):
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    return {
        "media_id": part(0), "testament": by_letter(F.substring(part(1), 1, 1)), "book_seq": F.substring(part(1), 2, 1_000), "book_id": part(2), "chapter": leading_int(part(3)),
        "verse": part(4), "chapter_end": leading_int(part(5)), "verse_end": part(6),
    }


def vox_name(name: Column) -> dict[str, Column]:
    """Parts of DRAMA_LANGUAGE_VERSION_seq_BOOK_chapter_rest names; N and O name the testament, P leaves it to the book. Other numbers of parts give nulls."""
    parts = F.split(name, "_")
    good = F.size(parts) == 7
    letter = F.substring(parts[0], 1, 1)
    testament = F.when(letter == "N", "NT").when(letter == "O", "OT").when(letter == "P", testament_of(parts[4]))
    own = {"testament": testament, "book_seq": parts[3], "book_id": parts[4], "chapter": parts[5].try_cast("int"), "media_id": F.concat(parts[1], parts[2], parts[0], F.lit("DA"))}
    return {n: F.when(good, c) for n, c in own.items()}


def requested(testament: Column, book_id: Column, ot: bool | list[str] = False, nt: bool | list[str] = False) -> Column:
    """Whether a file of this testament and book was asked for: a whole testament, or books of it; an empty book always counts."""
    def asked(of):
        return F.lit(True) if of is True else book_id.isin(list(of)) if of else F.lit(False)

    return (book_id == "") | F.when(testament == "NT", asked(nt)).otherwise(asked(ot))


def parse_reference(ref: Column) -> dict[str, Column]:
    """Book, chapter and verse, and the end of a range, of references as reference() writes them; missing parts are '' or 0."""
    got = {n: F.regexp_extract(ref, r"^(\S+)(?: (\d+)(?::([^-\s]*)(?:-(?:(\d+):)?([^:\s]*))?)?)?$", i) for i, n in enumerate(("book_id", "chapter", "verse", "chapter_end", "verse_end"), 1)}
    return got | {n: leading_int(got[n]) for n in ("chapter", "chapter_end")}


def yaml_value(text: Column, name: str) -> Column:
    """What follows the first "name:" up to the line's end, "unknown-name" without one."""
    at = F.instr(text, f"{name}:")
    rest = F.substring_index(F.substr(text, at + F.lit(len(name) + 1)), "\n", 1)
    return F.when(at > 0, F.trim(rest)).otherwise(f"unknown-{name}")


def fileset_id(text: Column) -> Column:
    """The first fileset id in a text, null without one."""
    return F.nullif(F.regexp_extract(text, "[A-Z][0-9][A-Z]{6}", 0), F.lit(""))


def bitrate_of(fileset: Column) -> Column:
    """The bitrate that an id's end names; 64 where it names none."""
    return F.coalesce(F.nullif(F.substring(fileset, 11, 100), F.lit("")), F.lit("64"))
