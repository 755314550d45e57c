"""Secret scans: fixed patterns, and a randomness test battery under false-discovery control.

Patterns find assignments, access keys and long hex runs. The battery looks at every run of 20 or more token
characters: the encoding is inferred as the smallest alphabet that holds the run; a chi-squared test of alphabet
uniformity, a runs test about the alphabet's middle and a lag-1 serial-correlation test are joined by Fisher's method.
Expected counts are below one here, so no test uses its limit distribution: each alphabet and length on a grid has a
table of the statistics of random strings, made once a worker, which turns a run into its share of random strings that
look less random (the score: even over 0 to 100 for keys, near 0 for prose, paths and words).

Short runs tell little, so the control depends on length: every document gives a decoy of its prose, of a length drawn
by the hash of its text, and every run one of its own length. Decoys and runs are counted by alphabet kind, length
class and score over all documents. A run's p-value is the share of decoys of its kind and class that score as high;
a class with fewer than `least_decoys` borrows from its neighbours, shorter ones first, then from the other kind. The
Benjamini-Hochberg step over all runs of the table outside the patterns' spans then bounds the expected share of false ones by `fdr`. So a rare
class reports by what the common ones have shown, and single-case letters, which prose has too, only at lengths that
tell. Runs of digits alone are numbers and not reported.

Defined results: null and empty texts have no spans; null ids and repeated rows stay, one row each; an empty table
gives an empty result; extra columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint, slices, text_buffers, text_rows

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
IS_HEX = np.zeros(256, dtype=bool)
IS_HEX[list(b"0123456789abcdef")] = True
TOKEN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
IS_TOKEN = np.zeros(256, dtype=bool)
IS_TOKEN[list(TOKEN_CHARS)] = True
#: By their frequency in prose, so that prose stays in the first half and fails the runs test; random strings have no such order.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
#: Alphabets from the smallest; the first that holds all symbols is the encoding.
ALPHABETS = [
    ("decimal", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("lower", LETTERS), ("upper", LETTERS.upper()),
    ("base32", LETTERS.upper() + "234567"), ("base36", LETTERS + "0123456789"), ("BASE36", LETTERS.upper() + "0123456789"), ("letters", LETTERS + LETTERS.upper()),
    ("base62", LETTERS + LETTERS.upper() + "0123456789"), ("base64", LETTERS + LETTERS.upper() + "0123456789+/"), ("base64url", LETTERS + LETTERS.upper() + "0123456789_-"),
    ("any", TOKEN_CHARS.decode()),
]
INDEX = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]
SINGLE_CASE = ("lower", "upper")
#: Least lengths of the length classes, and the lengths of the documents' decoys.
CLASSES = (20, 24, 32, 40, 64, 128)
DECOYS = (21, 27, 35, 48, 88, 160)
#: Lengths with a table of random strings; others use the next shorter one.
GRID = (8, 12, 16, 20, 22, 24, 26, 28, 32, 36, 40, 48, 56, 64, 80, 96, 128, 192, 256, 512)
STRINGS = 2_000


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES)


def statistics(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of symbol numbers below k: chi-squared of uniformity, runs about the middle and lag-1 serial products, standardised by length."""
    rows, n = at.shape
    counts = np.bincount((at + k * np.arange(rows)[:, None]).ravel(), minlength=k * rows).reshape(rows, k)
    chi = ((counts - n / k) ** 2).sum(1) / (n / k)
    high = at >= k / 2
    share = (k - (k + 1) // 2) / k
    flip = 2 * share * (1 - share)
    runs = ((high[:, 1:] != high[:, :-1]).sum(1) - flip * (n - 1)) / (n - 1) ** 0.5
    centred = at - (k - 1) / 2
    serial = (centred[:, 1:] * centred[:, :-1]).sum(1) / (n - 1) ** 0.5
    return (chi - (k - 1)) / (2 * k) ** 0.5, np.abs(runs), np.abs(serial)


@lru_cache(maxsize=512)
def random_strings(k: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted statistics of random strings of n symbols out of k, and their sorted Fisher sums."""
    found = statistics(np.random.default_rng(1_000 * k + n).integers(k, size=(STRINGS, n)), k)
    tables = [np.sort(x) for x in found]
    return tables, np.sort(sum(-np.log(tail(t, x)) for t, x in zip(tables, found, strict=True)))


def tail(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of the table that is as great, never 0."""
    return (len(table) - np.searchsorted(table, x - 1e-9) + 1) / (len(table) + 1)


def alphabet_of(body: str) -> tuple[str, dict[str, int]]:
    used = set(body)
    return next((name, i) for name, symbols, i in INDEX if used <= symbols)


def randomness(token: str) -> float:
    """The share of random strings of the inferred alphabet that look less random than the token."""
    body = token.rstrip("=")
    if len(body) < GRID[0]:
        return 0.0
    _, index = alphabet_of(body)
    at = np.fromiter((index[c] for c in body), dtype=np.int64, count=len(body))
    tables, sums = random_strings(len(index), max(g for g in GRID if g <= len(body)))
    fisher = sum(-log(tail(t, x)[0]) for t, x in zip(tables, statistics(at[None], len(index)), strict=True))
    return float(tail(sums, np.array([fisher]))[0])


def kind_of(token: str) -> int:
    """0 for letters of one case, which prose has too, 1 for other encodings, -1 for digits alone."""
    name, _ = alphabet_of(token.rstrip("=") or "=")
    return -1 if name == "decimal" else int(name not in SINGLE_CASE)


def runs_of(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each maximal run of `least` or more marked bytes that stays in its row."""
    n = len(mask)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    before = np.concatenate(([False], mask[:-1]))
    starts = np.flatnonzero(mask & (~before | head[:n]))
    after = np.concatenate((mask[1:], [False]))
    ends = np.flatnonzero(mask & (~after | head[1:])) + 1
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def decoy(raw: np.ndarray, prose: np.ndarray, at: int, want: int) -> str | None:
    """As many token characters as wanted from the prose after a place and then before it; None where there are too few."""
    reach = 8 * want + 64
    near = np.concatenate((np.arange(at, min(at + reach, len(raw))), np.arange(max(0, at - reach), at)))
    found = raw[near[prose[near]]][:want]
    return found.tobytes().decode() if len(found) == want else None


def scored(token: str) -> dict:
    return {"kind": kind_of(token), "class": length_class(len(token)), "score": int(100 * randomness(token))}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; base: pattern spans (start, rank, end); runs outside these: (start, end, kind, class, score in hundredths); decoys: (kind, class, score)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    score_type = [("kind", pa.int32()), ("class", pa.int32()), ("score", pa.int32())]

    def run(batches):
        for batch in slices(batches):
            column = batch.column("text")
            offsets, raw = text_buffers(column)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            tokens: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            decoys: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, text in enumerate(column.to_pylist()):
                low = text.lower()
                if any(w in low for w in WORDS):
                    found[i] += [{"start": m.start(), "rank": 0, "end": m.end()} for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
                if "AKIA" in text:
                    found[i] += [{"start": m.start(), "rank": 1, "end": m.end()} for m in ACCESS.finditer(text) if len(m[0]) >= 16]
            data = raw.tobytes()
            wide = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            for i, a, b in zip(*runs_of(IS_HEX[raw], offsets, 32), strict=True):
                at = int(wide[a] - wide[offsets[i]])
                found[i].append({"start": at, "rank": 2, "end": at + int(b - a)})
            prose = IS_TOKEN[raw]
            where = list(zip(*runs_of(prose, offsets, CLASSES[0]), strict=True))
            prose = prose.copy()
            for _, a, b in where:
                prose[a:b] = False
            for i, a, b in where:
                at = int(wide[a] - wide[offsets[i]])
                token = data[a:b].decode()
                if kind_of(token) >= 0:
                    tokens[i].append({"start": at, "end": at + int(b - a), **scored(token)})
                    decoys[i].append((b, int(b - a)))
            for i in range(batch.num_rows):
                first, last = int(offsets[i]), int(offsets[i + 1])
                draw = xxhash.xxh3_64_intdigest(data[first:last])
                places = [*decoys[i], (first + draw // 8 % max(last - first, 1), DECOYS[draw % len(DECOYS)])]
                strings = [decoy(raw[first:last], prose[first:last], int(at) - first, want) for at, want in places]
                decoys[i] = [scored(t) for t in strings if t is not None]
            # what a pattern has found already is not at stake
            tokens = [[t for t in own if not any(f["start"] < t["end"] and t["start"] < f["end"] for f in base)] for own, base in zip(tokens, found, strict=True)]
            columns = [batch.column("doc_id"), pa.array(found, span), pa.array(tokens, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *score_type]))), pa.array(decoys, pa.list_(pa.struct(score_type)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "runs", "decoys"])

    schema = "doc_id long, base array<struct<start int, rank int, end int>>, runs array<struct<start int, end int, kind int, class int, score int>>, decoys array<struct<kind int, class int, score int>>"
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)


def significant(runs: dict[tuple[int, int], np.ndarray], decoys: dict[tuple[int, int], np.ndarray], fdr: float, least_decoys: int) -> dict[tuple[int, int], int]:
    """The least score reported in each (kind, class), from the counts by score of runs and of decoys: Benjamini-Hochberg over all runs."""
    p_values = {}
    for kind, cls in runs:
        near = sorted(range(len(CLASSES) + 1), key=lambda c: (c > cls, abs(c - cls)))
        pooled = np.zeros(101, np.int64)
        for key in [(k, c) for k in (kind, 1 - kind) for c in near]:
            if pooled.sum() < least_decoys and key in decoys:
                pooled = pooled + decoys[key]
        p_values[kind, cls] = (1 + np.cumsum(pooled[::-1])[::-1]) / (1 + pooled.sum())
    total = sum(int(n.sum()) for n in runs.values())
    cells = sorted((p, int(n)) for key, counts in runs.items() for p, n in zip(p_values[key], counts, strict=True) if n)
    limit, rank = -1.0, 0
    for p, n in cells:
        rank += n
        # equal p-values have the last one's rank
        if p <= fdr * rank / total:
            limit = p
    return {key: int(np.argmax(p <= limit)) for key, p in p_values.items() if (p <= limit).any()}


def thresholds(scanned: DataFrame, fdr: float, least_decoys: int = 1_000) -> dict[tuple[int, int], int]:
    """The least reported score of each (kind, class). Counts cover all documents; kinds, classes and scores are few, whatever the input."""
    one = scanned.select(F.inline("runs")).select("kind", "class", "score", F.lit(True).alias("run"))
    other = scanned.select(F.inline("decoys")).filter("kind >= 0").select("kind", "class", "score", F.lit(False).alias("run"))
    found: tuple[dict, dict] = ({}, {})
    for r in one.unionByName(other).groupBy("kind", "class", "score", "run").agg(F.count("*").alias("n")).collect():
        found[not r["run"]].setdefault((r["kind"], r["class"]), np.zeros(101, np.int64))[r["score"]] = r["n"]
    return significant(*found, fdr, least_decoys) if found[0] else {}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; runs that overlap a pattern's span are not tested."""
    scanned = checkpoint(scan(docs, id_col, text_col))
    least = {10 * kind + cls: score for (kind, cls), score in thresholds(scanned, fdr).items()}
    known = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else None
    picked = F.filter("runs", lambda r: F.coalesce(F.element_at(known, 10 * r["kind"] + r["class"]) <= r["score"], F.lit(False)) if least else F.lit(False))
    added = F.transform(picked, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("rank"), r["end"].alias("end")))

    def joined(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")

    def count(rank):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", added)).alias("spans"), F.size(added).cast("long").alias("n_random"),
    )
