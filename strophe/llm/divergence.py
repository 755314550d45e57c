"""Audit of how the words of each source differ from those of the other sources of its language.

Texts become words in Arrow and NumPy: one table of bytes lowers A-Z and blanks what is no letter, a dictionary gives
each different word of a batch an integer, and documents and groups are counted over these. Spark sums by (language,
source, word) and keeps the words with enough documents. These are numbered in UTF-8 order, language by language, by
ranges (operators.numbering), and dealt to chunks of consecutive numbers so that a chunk times the sources of its
language stays below CELLS. In each chunk the sorted array of its words gives the ids (searchsorted) and one bincount
the dense matrix of sources and words. With the sums of all chunks known, each chunk gives its share of every pair of
sources, and of each source its best words, whose order by id is their order in UTF-8. Nothing is broadcast that grows
with the words, and a language that holds most rows has many chunks.

Proportions are in billionths with `smoothing` occurrences added to each word, computed in integers.

Defined results: null text, language and source count as ''. Repeated ids and rows are documents of their own, null ids
too. A language without kept words has pairs of value 0 and no words; an empty table gives an empty result. The sources
of one language must fit a task (each pair of them is in the result); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint, new_folder, slices, text_buffers
from strophe.operators.numbering import number

#: Sources times words of a chunk; the least words of a chunk; bytes of text that are counted at a time.
CELLS, LEAST, BATCH = 1 << 16, 64, 16 << 20
BILLION_STEPS = (1_000, 1_000, 1_000)

#: Bytes of words as they are, A-Z lowered, all other ASCII as a space; bytes of longer characters stay.
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32
WORD_BYTES[65:91] += 32


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every word of the texts, and the words that the codes stand for."""
    offsets, raw = text_buffers(column)
    plain = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(WORD_BYTES[raw].tobytes()))
    lists = pc.split_pattern(plain, " ")
    coded = lists.values.dictionary_encode()
    row, code = np.repeat(np.arange(len(column)), np.diff(lists.offsets.to_numpy())), coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    keep = code != empty
    return row[keep], code[keep], coded.dictionary


def counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); a null term marks each group that occurs."""

    def run(batches):
        for batch in slices(batches, limit=BATCH):
            row, code, words = words_of(batch.column("text"))
            both = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"]).to_pylist()
            names = sorted({(g["lang"], g["source"]) for g in both})
            place = {g: i for i, g in enumerate(names)}
            group = np.array([place[g["lang"], g["source"]] for g in both], np.int64)
            width = max(len(words), 1)
            cell, n = np.unique(group[row] * width + code, return_counts=True)
            in_docs = np.unique(row * width + code)
            _, n_docs = np.unique(group[in_docs // width] * width + in_docs % width, return_counts=True)
            of_group, of_word = cell // width, cell % width
            langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in range(2))
            marks = len(names)
            columns = [
                pa.concat_arrays([langs.take(pa.array(of_group)), langs]),
                pa.concat_arrays([sources.take(pa.array(of_group)), sources]),
                pa.concat_arrays([words.take(pa.array(of_word)).cast(pa.string()), pa.nulls(marks, pa.string())]),
                pa.array(np.concatenate((n, np.zeros(marks, np.int64)))),
                pa.array(np.concatenate((n_docs, np.zeros(marks, np.int64)))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def proportions(count: np.ndarray, total: np.ndarray, n_terms: int, smoothing: int) -> np.ndarray:
    """1 + floor(10**9 * (count + smoothing) / (total + smoothing * n_terms)), in integers of 64 bits: three decimals at a time."""
    under = total + smoothing * n_terms
    found, rest = np.divmod(count + smoothing, under)
    for step in BILLION_STEPS:
        digit, rest = np.divmod(rest * step, under)
        found = found * step + digit
    return 1 + found


def matrices(cells: DataFrame) -> DataFrame:
    """One row for each (lang, chunk) of the cells (source_id, term, n, n_sources): its terms in order, the counts by source, the sums by source."""

    def dense(group: pd.DataFrame) -> pd.DataFrame:
        sources = int(group["n_sources"].iloc[0])
        words = np.array([t.encode() for t in group["term"]], dtype=object)
        terms = np.unique(words)
        ids = np.searchsorted(terms, words)
        counts = np.bincount(group["source_id"].to_numpy(np.int64) * len(terms) + ids, group["n"].to_numpy(np.int64), sources * len(terms)).astype(np.int64)
        sums = counts.reshape(sources, len(terms)).sum(axis=1)
        return pd.DataFrame({"lang": group["lang"].iloc[:1].to_numpy(object), "chunk": group["chunk"].iloc[:1].to_numpy(), "terms": [[t.decode() for t in terms]], "counts": [counts], "sums": [sums]})

    return cells.groupBy("lang", "chunk").applyInPandas(dense, "lang string, chunk long, terms array<string>, counts array<long>, sums array<long>")


def compared(chunks: DataFrame, smoothing: int, most: int) -> DataFrame:
    """lang, source, part, item, value of each chunk: its share of every pair's distance, and each source's `most` strongest words in it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sources, terms, n_terms = row["sources"], row["terms"], row["n_terms"]
                count = np.array(row["counts"], np.int64).reshape(len(sources), len(terms))
                total = np.array(row["totals"], np.int64)
                p = proportions(count, total[:, None], n_terms, smoothing) if terms else count
                q = proportions(count.sum(axis=0), total.sum(), n_terms, smoothing) if terms else count[:0]
                found = []
                for i, own in enumerate(sources):
                    apart = np.abs(p - p[i]).sum(axis=1)
                    found += [(own, "pair", other, int(v)) for other, v in zip(sources, apart, strict=True) if other != own]
                    above = np.flatnonzero((count[i] > 0) & (p[i] > q)) if terms else []
                    if len(above):
                        f = p[i][above] - q[above]
                        best = np.lexsort((above, -f))[:most]
                        found += [(own, "term", terms[above[k]], int(f[k])) for k in best]
                columns = [pa.array([row["lang"]] * len(found), pa.string())] + [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    return chunks.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cells: int = CELLS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: the distance of each source to each other one of its language, and the `most` words that it has above its language's share."""
    spark = docs.sparkSession
    folder = new_folder(spark, "terms")
    counted(docs, text_col, lang_col, source_col).write.parquet(folder)
    found = spark.read.schema("lang string, source string, term string, n long, docs long").parquet(folder)

    groups = checkpoint(found.filter("term is null").select("lang", "source").withColumn("source_id", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    by_lang = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).withColumn("width", F.greatest(F.lit(LEAST), F.floor(F.lit(cells) / F.col("n_sources"))))

    kept = found.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of")).filter(F.col("docs") >= least_docs)
    kept = number(kept.select("lang", "term", "of"), ["term"], "id", keys=["lang"], start=0)
    dealt = kept.join(by_lang, "lang").select("lang", F.expr("id div width").alias("chunk"), "term", "n_sources", F.inline("of"))
    chunks = checkpoint(matrices(dealt.join(groups, ["lang", "source"]).select("lang", "chunk", "term", "n_sources", "source_id", "n")))

    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    sums = chunks.select("lang", F.posexplode("sums").alias("source_id", "n")).groupBy("lang", "source_id").agg(F.sum("n").alias("n"))
    totals = groups.join(sums, ["lang", "source_id"], "left").select("lang", "source_id", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    sides = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source_id", "source", "n"))).alias("s")).join(sizes, "lang", "left")
    sides = checkpoint(sides.select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("totals"), F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms")))

    whole = chunks.select("lang", "terms", "counts").join(sides, "lang")
    bare = sides.filter("n_terms = 0").select("lang", F.array().cast("array<string>").alias("terms"), F.array().cast("array<long>").alias("counts"), "sources", "totals", "n_terms")
    shares = compared(whole.unionByName(bare), smoothing, most)
    values = shares.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return values.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= most))
