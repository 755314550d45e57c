"""Reports as rows: the score report, the audio proof, the map of chapters to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions import numbers as nx
from strophe.operators import stats

#: Shares, labels and number formats of the report. Fixed values.
SHARES = (0.99, 0.991, 0.992, 0.993, 0.994, 0.995, 0.996, 0.997, 0.998, 0.999, 0.9991, 0.9992, 0.9993, 0.9994, 0.9995, 0.9996, 0.9997, 0.9998, 0.9999)


def score_report(df: DataFrame, score: Column) -> DataFrame:
    """section, place, label, value (text) of the -log10 of scores: moments, quantiles and histogram, from three aggregations."""
    errors = df.select(nx.neg_log10(score).alias("x"))
    m = stats.moments(errors, F.col("x"))
    named = [("Mean", "mean"), ("StdDev", "stddev"), ("Minimum", "min"), ("Maximum", "max"), ("Skewness", "skew"), ("Kurtosis", "kurtosis")]

    def row(section, place, label, value, shape):
        return F.struct(F.lit(section).alias("section"), place.cast("double").alias("place"), label.alias("label"), F.format_string(shape, value.cast("double")).alias("value"))

    first = m.select(F.inline(F.array(*[row("moments", F.lit(i), F.lit(n), F.col(c), "%.2f") for i, (n, c) in enumerate(named)])))
    q = stats.quantiles(errors, "x", SHARES)
    second = q.select(row("percentiles", F.col("p"), F.concat(F.lit("Percentile "), F.format_string("%.2f", F.col("p") * 100)), F.col("q"), "%.2f").alias("r")).select("r.*")
    h = stats.histogram(errors, "x")
    third = h.select(row("histogram", F.col("bucket"), F.concat(F.lit("Cat: "), F.col("bucket").cast("string"), F.lit("-"), (F.col("bucket") + 1).cast("string")), F.col("percent"), "%.4f").alias("r")).select("r.*")
    return first.unionByName(second).unionByName(third)


def proof_report(chars: DataFrame, line: str, word: str, order: str, silent: Column, critical: float = nx.CRITICAL, question: float = nx.QUESTION) -> DataFrame:
    """line, score, begin_ts, end_ts, html of the lines with errors, those without are left out.

    chars: ch, score, begin_ts, end_ts, is_asr. The line's score is its worst word's (stats.critical_words) plus 5 for
    each recognised character that is no space. Critical characters are red, questionable ones yellow, those before a
    long silence green, recognised ones blue.
    """
    heard = F.col("is_asr") & ~F.col("ch").rlike(r"^\s$")
    scores = stats.critical_words(chars, line, word, "score", heard, critical).select(line, F.col("score").alias("line_score")).filter("line_score > 0")
    colour = F.when(F.col("score") <= critical, "red").when(F.col("score") <= question, "yellow").when(silent, "green").when(heard, "blue")
    cell = F.when(colour.isNotNull(), F.concat(F.lit('<span class="'), colour, F.lit('-box">'), F.col("ch"), F.lit("</span>"))).otherwise(F.col("ch"))
    lines = chars.withColumn("_cell", cell).groupBy(line).agg(
        F.min_by("begin_ts", order).alias("begin_ts"), F.max_by("end_ts", order).alias("end_ts"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_cell"))), lambda s: s["_cell"]), "").alias("html"),
    )
    return scores.join(lines, line).select(line, F.col("line_score").alias("score"), "begin_ts", "end_ts", "html")


def file_map(files: DataFrame, dataset: str, book: str, chapter: str, file: str) -> DataFrame:
    """dataset, script: a line of script that maps each chapter of the dataset (a few hundred) to its file."""
    entries = files.select(dataset, book, chapter, file).distinct()
    entry = F.concat(F.lit("\t'"), F.col(book), F.col(chapter).cast("string"), F.lit("': '"), F.col(file), F.lit("'"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(book, chapter, entry.alias("e")))), lambda s: s["e"]), ",\n")
    return entries.groupBy(dataset).agg(F.concat(F.lit("let fileMap = {\n"), joined, F.lit("};\n")).alias("script"))
