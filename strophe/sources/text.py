"""Readers of text: USX markup, plain-text JSON, scripts with varying headers. Files are read in tasks, one row for each line."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import text as tx

#: Paragraph styles whose text belongs to verses; a trailing digit does not count. Fixed values.
VERSE_STYLES = {"p", "m", "po", "pr", "cls", "pmo", "pm", "pmc", "pmr", "pi", "mi", "nb", "pc", "ph", "b", "q", "qr", "qc", "qs", "qa", "qac", "qm", "qd", "lh", "li", "lf", "lim", "s", "ms", "mr", "r", "d", "sp", "h", "mt", "mte", "toc"}
#: Styles of the running heading and the main titles, which are no lines of text but feed read_usx_titles. Fixed values.
TITLES = ("h", "mt", "mt1", "mt2", "mt3")
SCHEMA = "book_id string, chapter_num int, verse_str string, usfm_style string, script_text string, seq long"
#: Header synonyms of scripts. Fixed values.
HEADERS = {
    "book_id": ("book", "bk", "book_id"), "chapter_num": ("chapter", "cp", "chapter_num"), "verse_str": ("verse", "verse_number", "vs", "verse_str"),
    "script_num": ("line", "line_number", "line id:", "script_num"), "person": ("character", "characters", "person"), "actor": ("reader", "reader name", "actor"), "script_text": ("text", "target language", "script_text"),
}
BOOK_FIXES = {"JMS": "JAS", "TTS": "TIT"}


def in_verses(style: str) -> bool:
    """Whether a paragraph's text belongs to verses: one digit at the end of its style does not count, a style that is not known does not belong."""
    return (style[:-1] if style[-1:].isdigit() else style) in VERSE_STYLES


def usx_lines(data: bytes) -> list[tuple[str, int, str, str, str]]:
    """(book, chapter, verse, style, text) in document order; text is cut at verse and chapter marks, and braces become parentheses."""
    book, chapter, verse, out = "", 0, "0", []
    held: list[str] = []
    style = ""

    def flush():
        text = "".join(held).replace("{", "(").replace("}", ")")
        if text.strip():
            if out and out[-1][:3] == (book, chapter, verse):
                out[-1] = (*out[-1][:4], out[-1][4] + text)
            else:
                out.append((book, chapter, verse, style, text))
        held.clear()

    def walk(node):
        nonlocal book, chapter, verse, style
        own = node.get("style", "")
        if node.tag == "book":
            book = node.get("code", "")
        elif node.tag == "chapter":
            flush()
            if node.get("number"):
                chapter, verse = int(node.get("number")), "0"
        elif node.tag == "verse":
            flush()
            if node.get("number"):
                verse = node.get("number")
        elif node.tag == "para" and (own in TITLES or not in_verses(own)) or node.tag in ("note", "figure", "sidebar"):
            return
        else:
            if node.tag == "para":
                flush()
                style = own
            if node.text:
                held.append(node.text)
            for child in node:
                walk(child)
                if child.tail:
                    held.append(child.tail)
            if node.tag == "para":
                flush()

    for child in ET.fromstring(data):
        walk(child)
    flush()
    return [(b, c, v, s, " ".join(t.split())) for b, c, v, s, t in out]


def read_usx(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every USX file under the path, also inside zip archives."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [r for part in unzip(name, data.as_py()) for r in usx_lines(part)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))), pa.array(range(len(rows)), pa.int64())],
                    names=["book_id", "chapter_num", "verse_str", "usfm_style", "script_text", "seq"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def usx_titles(data: bytes) -> tuple[str, str, str]:
    """(book, heading, title): the last running heading (h), and all main titles (mt, mt1, ...) as one line."""
    book, heading, titles = "", "", []
    for node in ET.fromstring(data).iter():
        style = node.get("style", "")
        if node.tag == "book":
            book = node.get("code", "")
        elif node.tag == "para" and style == "h":
            heading = " ".join("".join(node.itertext()).split())
        elif node.tag == "para" and style in TITLES:
            titles.append(" ".join("".join(node.itertext()).split()))
    return book, heading, " ".join(titles)


def usx_styles(data: bytes) -> list[str]:
    return [node.get("style", "") for node in ET.fromstring(data).iter("para")]


def of_usx_files(spark: SparkSession, path: str, f: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """f's rows of every USX file under the path, also inside zip archives."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [r for part in unzip(name, data.as_py()) for r in f(part)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_usx_titles(spark: SparkSession, path: str) -> DataFrame:
    """book_id, heading, title of every USX file."""
    return of_usx_files(spark, path, lambda data: [usx_titles(data)], "book_id string, heading string, title string")


def read_usx_styles(spark: SparkSession, path: str) -> DataFrame:
    """style, n, in_verses: how often each paragraph style occurs, and whether read_usx takes its text; the others are to be looked at."""
    found = of_usx_files(spark, path, lambda data: [(s,) for s in usx_styles(data)], "style string").groupBy("style").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("style", "[0-9]$", "")
    return found.select("style", "n", bare.isin(sorted(VERSE_STYLES)).alias("in_verses"))


def add_usx_headings(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines of read_usx with the book's title (para.mt) before the first one and "heading chapter" (para.h) before each chapter after the first, as verse 0; numbered again in each chapter.

    lines: book_id, chapter_num, verse_str, usfm_style, script_text, seq; titles: read_usx_titles. A book without titles has empty ones.
    """
    first = lines.groupBy("book_id").agg(F.min_by("chapter_num", "seq").alias("chapter_num"))
    text = titles.groupBy("book_id").agg(F.max("heading").alias("heading"), F.max("title").alias("title"))
    top = first.join(text, "book_id", "left").select("book_id", "chapter_num", F.lit(0).alias("kind"), F.lit("0").alias("verse_str"), F.lit("para.mt").alias("usfm_style"), F.coalesce("title", F.lit("")).alias("script_text"), F.lit(-1).cast("long").alias("seq"))
    chapters = lines.filter("chapter_num != 1").select("book_id", "chapter_num").distinct().join(text, "book_id", "left")
    named = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.col("chapter_num").cast("string"))
    heads = chapters.select("book_id", "chapter_num", F.lit(1).alias("kind"), F.lit("0").alias("verse_str"), F.lit("para.h").alias("usfm_style"), named.alias("script_text"), F.lit(-1).cast("long").alias("seq"))
    own = lines.select("book_id", "chapter_num", F.lit(2).alias("kind"), "verse_str", "usfm_style", "script_text", F.col("seq").cast("long").alias("seq"))
    number = F.row_number().over(Window.partitionBy("book_id", "chapter_num").orderBy("kind", "seq"))
    return own.unionByName(top).unionByName(heads).select("book_id", "chapter_num", number.alias("script_num"), "verse_str", "usfm_style", "script_text")


def unzip(name: str, data: bytes) -> list[bytes]:
    """The members of an archive in name order without hidden ones, or the file itself."""
    if not name.lower().endswith(".zip"):
        return [data]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if not n.endswith("/") and not n.rsplit("/", 1)[-1].startswith(".")), key=lambda n: n.rsplit("/", 1)[-1])
        return [z.read(n) for n in names]


def read_plain_json(spark: SparkSession, path: str, sequence: DataFrame) -> DataFrame:
    """Lines of {data: [...]} files in the order of (book, chapter, verse); sequence: book_id, book_seq. Line numbers restart in each book."""
    row = "struct<book_id: string, chapter: int, verse_start: string, verse_end: string, verse_text: string>"
    rows = spark.read.schema(f"data array<{row}>").json(path, multiLine=True).select(F.inline("data"))
    text = F.replace(F.replace("verse_text", F.lit("&lt"), F.lit("<")), F.lit("&gt"), F.lit(">"))
    end = F.coalesce("verse_end", F.lit(""))
    verse = F.when((end == "") | (end == F.col("verse_start")), F.col("verse_start")).otherwise(F.concat("verse_start", F.lit("-"), end))
    rows = rows.join(sequence, "book_id", "left").withColumn("n", tx.leading_int(F.col("verse_start")))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter", "n"))
    return rows.select("book_id", "book_seq", F.col("chapter").alias("chapter_num"), verse.alias("verse_str"), number.alias("script_num"), text.alias("script_text"))


def resolve_headers(df: DataFrame, required: Sequence[str] = ("book_id", "chapter_num", "script_text")) -> DataFrame:
    """A script table under the dataset's column names, whatever synonyms its headers use; book codes are corrected."""
    found = {}
    for name, synonyms in HEADERS.items():
        for c in df.columns:
            if c.strip().lower() in synonyms and name not in found:
                found[name] = c
    if missing := [r for r in required if r not in found]:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    out = df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])
    fixes = F.create_map(*[F.lit(x) for kv in BOOK_FIXES.items() for x in kv])
    out = out.withColumn("book_id", F.coalesce(fixes[F.upper("book_id")], F.upper("book_id"))).withColumn("chapter_num", tx.leading_int(F.col("chapter_num").cast("string")))
    return out.withColumn("verse_str", F.when(F.col("verse_str").contains("<<"), "0").otherwise(F.coalesce("verse_str", F.lit("")))) if "verse_str" in found else out


def read_csv_script(spark: SparkSession, path: str) -> DataFrame:
    return resolve_headers(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def add_headings(lines: DataFrame, titles: DataFrame, headings: DataFrame) -> DataFrame:
    """Lines with a title before each book and a heading before each chapter but the first, numbered again in each book.

    lines: book_id, chapter_num, script_num, script_text; titles: book_id, script_text; headings: book_id, chapter_num, script_text.
    """
    first = lines.groupBy("book_id").agg(F.min("chapter_num").alias("first_chapter"))
    own = lines.select("book_id", "chapter_num", F.lit(1).alias("kind"), F.col("script_num").cast("long").alias("old_num"), "script_text")
    title = titles.join(first, "book_id").select("book_id", F.col("first_chapter").alias("chapter_num"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("old_num"), "script_text")
    chapters = lines.select("book_id", "chapter_num").distinct().join(first, "book_id").filter("chapter_num > first_chapter")
    heads = headings.join(chapters, ["book_id", "chapter_num"]).select("book_id", "chapter_num", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("old_num"), "script_text")
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_num", "kind", "old_num"))
    return own.unionByName(title).unionByName(heads).select("book_id", "chapter_num", number.alias("script_num"), "script_text")


def read_known_errors(spark: SparkSession, path: str) -> DataFrame:
    """reference, word_seq, word, kind of a list of known errors (CSV without a header); a number that is none is 0."""
    rows = spark.read.csv(path, schema="reference string, word_seq string, word string, kind string", multiLine=True, escape='"')
    return rows.select(F.trim("reference").alias("reference"), F.coalesce(F.trim("word_seq").try_cast("int"), F.lit(0)).alias("word_seq"), F.trim("word").alias("word"), F.trim("kind").alias("kind"))


PAIR = (
    "ref struct<book_id: string, chapter_num: int, verse_str: string, chapter_end: int, verse_end: string>, script_num string, audio_file string, begin_ts double, end_ts double, "
    "base struct<script_id: long, text: string, uroman: string>, comp struct<script_id: long, text: string, uroman: string>, diffs array<struct<Type: int, Text: string>>"
)


def read_pairs(spark: SparkSession, path: str, book: str = "", chapter: int = 0) -> DataFrame:
    """Compared pairs of a JSON array, of one book or one chapter of it, by script_id: the base's, else the compared side's."""
    rows = spark.read.schema(PAIR).json(path, multiLine=True)
    if book:
        rows = rows.filter(F.col("ref.book_id") == book)
        rows = rows.filter(F.col("ref.chapter_num") == chapter) if chapter else rows
    own = F.coalesce(F.nullif(F.col("base.script_id"), F.lit(0).cast("long")), F.col("comp.script_id"))
    return rows.withColumn("script_id", own)


def fileset_globs(root: str, dataset: str, kind: str, old: str = "", new: str = "") -> list[str]:
    """Path patterns of a dataset's filesets of both testaments for spark.read: JSON files, USX folders, or audio whose names begin with A or B."""
    found = []
    for fileset, letter in ((old, "A"), (new, "B")):
        if fileset and kind in ("text_plain", "text_plain_edit"):
            found.append(f"{root}/{dataset}/{fileset}.json")
        elif fileset:
            found.append(f"{root}/{dataset}/{fileset}/" + ("*.usx" if kind == "text_usx_edit" else f"{letter}*.mp3"))
    return found


#: Folders of artefacts under a media id. Fixed values.
ARTEFACTS = {"script_path": "core_script/", "script_ts_path": "cue_info_text/", "line_ts_path": "aeneas_line_timings/", "verse_ts_path": "aeneas_verse_timings/"}


def artefact_paths(listing: DataFrame, media: DataFrame) -> DataFrame:
    """media_id, a path column for each kind of artefact ('' where nothing lies under it) and n, the files under the last kind. listing: path ("prefix/media_id/kind/..."); one pass over it."""
    parts = F.split("path", "/")
    kind = F.concat(F.element_at(parts, -2), F.lit("/"))
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    files = listing.select(F.element_at(parts, -3).alias("media_id"), kind.alias("kind"), F.concat(folder, F.lit("/")).alias("folder")).filter(kind.isin(list(ARTEFACTS.values())))
    found = files.groupBy("media_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("folder"))).alias(n) for n, k in ARTEFACTS.items()], F.count_if(F.col("kind") == ARTEFACTS["verse_ts_path"]).alias("n"))
    return media.join(found, "media_id", "left").select("media_id", *[F.coalesce(n, F.lit("")).alias(n) for n in ARTEFACTS], F.coalesce("n", F.lit(0)).alias("n"))
