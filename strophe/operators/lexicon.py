"""Decoding of frames with a lexicon: n-gram counts by Spark, a trie of spellings, a beam with back-off.

A hypothesis is a place in the trie, the last words, and the last label with whether a blank came after it; of two that
agree in these the better one stays, so with a beam wide enough the best word sequence is found. Words are scored when
their spelling ends, by the longest history that was seen, each shorter one for a penalty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
#: Score of a word that no n-gram has, and of each step to a shorter history (log 10).
UNSEEN, BACK_OFF = -7.0, math.log10(0.4)
#: Rows of the lexicon and of the n-gram table that tasks hold at most.
MOST_WORDS, MOST_NGRAMS = 500_000, 2_000_000
#: Scored words that a decoder keeps.
KEPT = 300_000


def ngrams(lines: DataFrame, words: str, order: int = 3) -> DataFrame:
    """history (array<string>), word, n, score (log 10 of the share of the history's followers) of every n-gram up to `order` words; lines begin and end with marks."""
    padded = F.concat(F.array(F.lit(BEGIN)), F.filter(F.col(words), lambda w: w.isNotNull()), F.array(F.lit(END)))
    spread = lines.filter(F.col(words).isNotNull()).select(padded.alias("w")).select("w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("at"))
    back = F.explode(F.sequence(F.lit(0), F.least(F.lit(order), F.col("at")) - 1)).alias("k")
    each = spread.select("w", "at", back).select(F.slice("w", F.col("at") - F.col("k"), F.col("k")).alias("history"), F.element_at("w", F.col("at")).alias("word"))
    counted = each.groupBy("history", "word").agg(F.count("*").alias("n"))
    totals = counted.groupBy("history").agg(F.sum("n").alias("total"))
    return counted.join(totals, "history").select("history", "word", "n", F.log10(F.col("n") / F.col("total")).alias("score"))


class Decoder:
    def __init__(self, spellings: list[tuple[str, list[int]]], table: list[tuple[tuple[str, ...], str, float]], order: int, weight: float, word_score: float, width: int, blank: int):
        self.child: list[dict[int, int]] = [{}]
        self.words: list[list[str]] = [[]]
        for word, labels in sorted(spellings):
            node = 0
            for label in labels:
                if label not in self.child[node]:
                    self.child[node][label] = len(self.child)
                    self.child.append({})
                    self.words.append([])
                node = self.child[node][label]
            if node:
                self.words[node].append(word)
        self.scores = {(history, word): score for history, word, score in table}
        self.order, self.weight, self.word_score, self.width, self.blank = order, weight, word_score, width, blank
        self.known: dict[tuple[int, tuple[str, ...]], list[tuple[float, str, tuple[str, ...]]]] = {}
        self.n_known = 0

    def ending(self, node: int, history: tuple[str, ...]) -> list[tuple[float, str, tuple[str, ...]]]:
        """Weighted score, word and next history of the words spelled at a node, best first; up to KEPT words are kept for the next time."""
        found = self.known.get((node, history))
        if found is None:
            keep = self.order - 1
            found = sorted((-self.weight * self.score(history, word), word, (*history, word)[-keep:] if keep else ()) for word in self.words[node])
            found = [(-x, word, after) for x, word, after in found]
            self.n_known += len(found) + 1
            if self.n_known > KEPT:
                self.known, self.n_known = {}, len(found) + 1
            self.known[node, history] = found
        return found

    def score(self, history: tuple[str, ...], word: str) -> float:
        penalty = 0.0
        while True:
            found = self.scores.get((history, word))
            if found is not None:
                return penalty + found
            if not history:
                return penalty + UNSEEN
            history, penalty = history[1:], penalty + BACK_OFF

    def decode(self, frames: list[list[float]]) -> tuple[float, list[str]] | None:
        """Score and words of the best hypothesis whose last word is whole; of equal ones the first words in order."""
        keep = self.order - 1
        beam: dict[tuple, tuple[float, tuple[str, ...]]] = {(0, (BEGIN,)[:keep], -1, False): (0.0, ())}
        for frame in frames:
            after: dict[tuple, tuple[float, tuple[str, ...]]] = {}

            def add(key: tuple, score: float, words: tuple[str, ...], after=after) -> None:
                held = after.get(key)
                if held is None or (-score, words) < (-held[0], held[1]):
                    after[key] = (score, words)

            # no more than `width` of a frame's hypotheses stay: once so many are known, words that end below all of them are left out
            least, full = -math.inf, 2 * self.width
            for (node, history, last, gap), (score, words) in beam.items():
                if len(after) >= full:
                    least, full = sorted((x for x, _ in after.values()), reverse=True)[self.width - 1], 2 * len(after)
                add((node, history, last, True), score + frame[self.blank], words)
                if last >= 0 and not gap:
                    add((node, history, last, False), score + frame[last], words)
                for label, below in self.child[node].items():
                    if label == last and not gap:
                        continue
                    reached = score + frame[label]
                    if self.child[below]:
                        add((below, history, label, False), reached, words)
                    if self.words[below]:
                        for said, word, follows in self.ending(below, history):
                            whole = reached + said + self.word_score
                            if whole < least:
                                break
                            add((0, follows, label, False), whole, (*words, word))
            beam = dict(sorted(after.items(), key=lambda x: (-x[1][0], x[1][1]))[: self.width])
        ends = [(s + self.weight * self.score(history, END), words) for (node, history, _, _), (s, words) in beam.items() if node == 0 and words]
        if not ends:
            return None
        best = min(ends, key=lambda x: (-x[0], x[1]))
        return best[0], list(best[1])


def decode(df: DataFrame, key: str, frames: str, spellings: DataFrame, table: DataFrame, order: int = 3, weight: float = 1.0, word_score: float = 0.0, width: int = 500, blank: int = 0) -> DataFrame:
    """key, words, score of every row: frames (arrays of log probabilities) read as words.

    spellings: word, labels; table: ngrams() of them. Both are sent to the tasks; more rows than MOST_WORDS or
    MOST_NGRAMS raise, as a language has no more (drop n-grams that were seen once). Spellings that are null, empty or
    hold the blank or a null take no part. Null or empty frames, frames without a reading and frames too narrow for a
    spelling's label have null in words and score.
    """
    kind = df.schema[key].dataType.simpleString()
    usable = spellings.filter(F.col("word").isNotNull() & (F.size("labels") > 0) & F.forall("labels", lambda x: x.isNotNull() & (x != blank) & (x >= 0))).select("word", "labels").distinct()
    sides = []
    for side, most in ((usable, MOST_WORDS), (table.select("history", "word", "score"), MOST_NGRAMS)):
        found = side.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} rows would go to every task")
        sides.append(found)
    words = [(r["word"], list(r["labels"])) for r in sides[0]]
    scores = [(tuple(r["history"]), r["word"], r["score"]) for r in sides[1]]
    sent = df.sparkSession.sparkContext.broadcast((words, scores))
    least = max((max(labels) for _, labels in words), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(*sent.value, order, weight, word_score, width, blank)
        for batch in batches:
            found = [own.decode(f) if f and all(x is not None and len(x) >= least and None not in x for x in f) else None for f in batch.column("frames").to_pylist()]
            columns = [batch.column("key"), pa.array([x and x[1] for x in found], pa.list_(pa.string())), pa.array([x and x[0] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "words", "score"])

    rows = df.select(F.col(key).alias("key"), F.col(frames).cast("array<array<double>>").alias("frames"))
    # a row takes milliseconds, and a table of few blocks would be read by few tasks
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("key", "frames"))
    return rows.mapInArrow(run, f"{key} {kind}, words array<string>, score double")
