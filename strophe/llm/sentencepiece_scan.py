"""SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

A segmentation is the best path of pieces under the vocabulary's scores (unigram inference). Any vocabulary file can
be read that way, also one whose scores are merge ranks: nothing is trained and no piece or score changes. Bytes stand
for characters without a piece; among equal scores the longer last piece wins. Scores are added in double precision,
so the path is a true optimum (the library's single-precision pass is not, for rank scores). No piece spans a
line feed, the place before a space mark, or a change between ASCII letters and other ASCII characters (this is
checked), so ordinary documents fall into words whose best paths are found once each and kept; a vocabulary without
that property is searched over whole texts.

Giant documents are cut into chunks of characters in one pass. The state at a boundary is the number of characters by
which a piece reaches over it. Each chunk yields a matrix (entry state x exit state -> best score). Matrices compose by
max-plus products, which are associative: runs of RUN chunks are multiplied in parallel, a scan over the products gives
each run the scores at its entry, and a scan inside each run those of its chunks. Then every chunk walks back from each
exit state by itself; the states alone are chained back per document, and each chunk's walk is picked by its state.

Defined results: null text counts as empty and has no ids; null ids and repeated rows stay, one row each; an empty
table gives an empty result; extra columns are ignored. No text is cut or capped.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint, slices, text_rows

MARK = "▁"
NEG = -np.inf
#: What an unknown character scores below the least normal piece; fixed in the library.
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 260_000
#: Chunks whose matrices are multiplied together before the scan.
RUN = 64
ASCII_RUN = r"(?:[A-Za-z]+|[\x00-\x09\x0b-@\[-`{-\x7f]+)"
OTHERS = rf"[^\x00-\x7f{MARK}]+"
#: A line feed, or space marks with what follows up to the next mark, line feed or change between ASCII letters and other ASCII.
WORD = re.compile(rf"\n|{MARK}*(?:{ASCII_RUN}|{OTHERS}{ASCII_RUN}?)(?:{OTHERS}{ASCII_RUN}?)*|{MARK}+")


def falls_apart(piece: str) -> bool:
    """Whether WORD would cut inside the piece."""
    return len(WORD.findall(piece)) != 1


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(field number, wire type, start, end) of each field of a serialized message; start and end bound the value."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 2:
            size, at = varint(data, at)
            end = at + size
        elif kind == 0:
            _, end = varint(data, at)
        else:
            end = at + (4 if kind == 5 else 8)
        yield key >> 3, kind, at, end
        at = end


class Vocabulary:
    """Pieces, scores and byte ids of a model file, and the library's processor for it."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = [next((varint(model[a:b], s)[0] for n, _, s, _ in fields(model[a:b]) if n == 3), 1) for number, _, a, b in fields(model) if number == 1]
        pieces = [self.library.id_to_piece(i) for i in range(len(kinds))]
        normal = [self.library.get_score(i) for i, k in enumerate(kinds) if k == 1]
        most, self.unknown = max(normal), min(normal) - UNKNOWN_PENALTY
        self.ids, self.prefixes = {}, set()
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 6}
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k in (1, 4):
                # user-defined pieces always win
                self.ids[p] = (i, self.library.get_score(i) if k == 1 else len(p.encode()) * most - 0.1)
                self.prefixes.update(p[:n] for n in range(1, len(p) + 1))
        self.reach = max(map(len, self.ids))
        self.local = not any(map(falls_apart, self.ids))
        #: scores of pieces, and of their beginnings that are no pieces: minus infinity
        self.scores = {p: NEG for p in self.prefixes} | {p: s for p, (_, s) in self.ids.items()}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def best(self, text: str) -> bytes:
        """The best path's ids, as little-endian int32, of a text that starts and ends on piece boundaries."""
        n = len(text)
        scores, starts = [0.0] + [NEG] * n, [0] * (n + 1)
        ids, score_of, unknown = self.ids, self.scores.get, self.unknown
        for at in range(n):
            base, end = scores[at], at + 1
            score = score_of(text[at:end])
            if (score is None or score == NEG) and base + unknown > scores[end]:
                scores[end], starts[end] = base + unknown, at
            while score is not None:
                if base + score > scores[end]:
                    scores[end], starts[end] = base + score, at
                end += 1
                if end > n:
                    break
                score = score_of(text[at:end])
        out, at = [], n
        while at:
            piece = text[starts[at] : at]
            if piece in ids:
                out.append(ids[piece][0])
            else:
                out += [self.bytes[b] for b in reversed(piece.encode())]
            at = starts[at]
        return np.array(out[::-1], dtype="<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian int32; the best paths of words are kept, up to WORDS_KEPT of them."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if not self.local:
            return self.best(marked)
        known, parts = self.known, []
        for word in WORD.findall(marked):
            ids = known.get(word)
            if ids is None:
                ids = self.before.get(word)
                if ids is None:
                    ids = self.best(word)
                if len(word) <= 64:
                    if 2 * len(known) >= WORDS_KEPT:  # words still in use move on from the older half
                        self.before = known
                        known = self.known = {}
                    known[word] = ids
            parts.append(ids)
        return b"".join(parts)

    def forward(self, text: str, n: int, entry: np.ndarray, like: list[float] | None = None) -> tuple[list[float], list[int], float | None]:
        """Best scores and starts at positions 0..n + reach - 1 for pieces that start before n; entry[j] is the score of a piece that ends at j from before (start -1).

        With `like`, the scores of another entry, the sweep ends early once the last `reach` settled scores differ from
        those by one number, as all later ones then do too; that number is returned.
        """
        scores, starts = [*entry.tolist(), *[NEG] * n], [-1] * (n + self.reach)
        score_of, unknown, length, reach = self.scores.get, self.unknown, len(text), self.reach
        for at in range(n):
            if like is not None and at >= reach and at % 32 == 0:
                own, other = scores[at - reach + 1 : at + 1], like[at - reach + 1 : at + 1]
                shift = {x - y for x, y in zip(own, other, strict=True) if x != NEG or y != NEG}
                if len(shift) == 1 and abs(one := shift.pop()) != -NEG:
                    return scores, starts, one
            base = scores[at]
            if base == NEG:
                continue
            end = at + 1
            score = score_of(text[at:end])
            if (score is None or score == NEG) and base + unknown > scores[end]:
                scores[end], starts[end] = base + unknown, at
            while score is not None:
                if base + score > scores[end]:
                    scores[end], starts[end] = base + score, at
                end += 1
                if end > length:
                    break
                score = score_of(text[at:end])
        return scores, starts, None

    def transfer(self, text: str, n: int) -> np.ndarray:
        """Matrix of best scores from each entry state to each exit state of a chunk of n characters; text has the characters after it too."""
        size = self.reach
        matrix = np.full((size, size), NEG)
        reference: list[float] | None = None
        for j in range(size):
            if j >= n:
                if j - n < size:
                    matrix[j, j - n] = 0.0
                continue
            entry = np.full(size, NEG)
            entry[j] = 0.0
            scores, _, shift = self.forward(text, n, entry, reference)
            matrix[j] = scores[n : n + size] if shift is None else matrix[0] + shift
            reference = reference or scores
        return matrix

    def walks(self, text: str, n: int, entry: np.ndarray) -> dict[int, tuple[int, list[int]]]:
        """For each exit state that is reached: the entry state and the ids of the pieces that start in the chunk."""
        scores, starts, _ = self.forward(text, n, entry)
        out = {}
        for k in range(self.reach):
            if scores[n + k] == NEG:
                continue
            at, ids = n + k, []
            while starts[at] >= 0:
                piece = text[starts[at] : at]
                if piece in self.ids:
                    ids.append(self.ids[piece][0])
                else:
                    ids += [self.bytes[b] for b in reversed(piece.encode())]
                at = starts[at]
            out[k] = (at, ids[::-1])
        return out


def shared_start(walks: dict[int, tuple[int, list[int]]]) -> dict:
    """The walks with the ids that all of them begin with held once; they have those in common only if they enter in one state."""
    own = list(walks.values())
    n = 0
    if len({entry for entry, _ in own}) == 1:
        first, last = min(ids for _, ids in own), max(ids for _, ids in own)
        n = next((i for i, (x, y) in enumerate(zip(first, last, strict=False)) if x != y), min(len(first), len(last)))
    return {"common": own[0][1][:n] if own else [], "exits": [{"exit": k, "entry": e, "tail": ids[n:]} for k, (e, ids) in walks.items()]}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_small(docs: DataFrame, model: str) -> DataFrame:
    def run(batches):
        words = vocabulary(model)
        for batch in slices(batches):
            parts = [words.encode(t) for t in batch.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def after(entry: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Best scores at the exit states, given those at the entry states (a row) or of several entries (rows)."""
    return (entry[..., :, None] + matrix).max(axis=-2)


def encode_giant(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    """doc_id, ids by the scan; rows of docs are told apart by a row key, so repeated ids stay apart."""
    reach = vocabulary(model).reach

    def cut(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                marked = MARK + text.replace(" ", MARK)
                for at in range(0, len(marked), 64 * chunk):
                    starts = range(at, min(at + 64 * chunk, len(marked)), chunk)
                    columns = [pa.array([row] * len(starts)), pa.array([doc_id] * len(starts), pa.int64()), pa.array([i // chunk for i in starts], pa.int32())]
                    columns += [pa.array([min(chunk, len(marked) - i) for i in starts], pa.int32()), pa.array([marked[i : i + chunk + reach] for i in starts])]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "chunk", "size", "part"])

    keyed = docs.select(F.expr("uuid()").alias("row"), "doc_id", "text").mapInArrow(cut, "row string, doc_id long, chunk int, size int, part string")
    keyed = checkpoint(keyed.repartition("row", "chunk"))

    def matrices(batches):
        words = vocabulary(model)
        for batch in batches:
            cells = [words.transfer(p.as_py(), n.as_py()).ravel() for p, n in zip(batch.column("part"), batch.column("size"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(cells, pa.list_(pa.float64()))], names=["row", "chunk", "cells"])

    def in_order(group: pd.DataFrame, by: str) -> tuple[pd.DataFrame, list[np.ndarray]]:
        group = group.sort_values(by)
        return group, [np.array(c).reshape(reach, reach) for c in group["cells"]]

    def product(group: pd.DataFrame) -> pd.DataFrame:
        group, own = in_order(group, "chunk")
        total = own[0]
        for m in own[1:]:
            total = after(total, m)
        return pd.DataFrame({"row": group["row"].iloc[:1], "run": group["run"].iloc[:1], "cells": [total.ravel()]})

    def scanned(group: pd.DataFrame, by: str, entry: np.ndarray) -> pd.DataFrame:
        group, own = in_order(group, by)
        entries = []
        for m in own:
            entries.append(entry)
            entry = after(entry, m)
        return pd.DataFrame({"row": group["row"], by: group[by], "entry": entries})

    def scan_runs(group: pd.DataFrame) -> pd.DataFrame:
        start = np.full(reach, NEG)
        start[0] = 0.0
        return scanned(group, "run", start)

    def scan_chunks(group: pd.DataFrame) -> pd.DataFrame:
        return scanned(group, "chunk", np.array(group["entry"].iloc[0]))

    walk_type = "struct<common: array<int>, exits: array<struct<exit: int, entry: int, tail: array<int>>>>"

    def back(batches):
        words = vocabulary(model)
        kind = pa.struct([("common", pa.list_(pa.int32())), ("exits", pa.list_(pa.struct([("exit", pa.int32()), ("entry", pa.int32()), ("tail", pa.list_(pa.int32()))])))])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, n, entry = (row.column(c)[0].as_py() for c in ("part", "size", "entry"))
                walks = pa.array([shared_start(words.walks(part, n, np.array(entry)))], kind)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("row", "doc_id", "chunk")), walks], names=["row", "doc_id", "chunk", "walks"])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        """From the last chunk back, each chunk's exit state is the entry state of the one after it; the last one's is 0."""
        group = group.sort_values("chunk", ascending=False)
        state, states = 0, []
        for exits in group["exits"]:
            states.append(state)
            state = next(e["entry"] for e in exits if e["exit"] == state)
        return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "state": states})

    cells = checkpoint(keyed.select("row", "chunk", "size", "part").mapInArrow(matrices, "row string, chunk int, cells array<double>")).withColumn("run", F.floor(F.col("chunk") / RUN).cast("int"))
    runs = cells.groupBy("row", "run").applyInPandas(product, "row string, run int, cells array<double>").groupBy("row").applyInPandas(scan_runs, "row string, run int, entry array<double>")
    entries = cells.join(runs, ["row", "run"]).groupBy("row", "run").applyInPandas(scan_chunks, "row string, chunk int, entry array<double>")
    walked = checkpoint(keyed.join(entries, ["row", "chunk"]).select("row", "doc_id", "chunk", "size", "part", "entry").mapInArrow(back, f"row string, doc_id long, chunk int, walks {walk_type}"))
    steps = walked.select("row", "chunk", F.transform("walks.exits", lambda e: F.struct(e["exit"].alias("exit"), e["entry"].alias("entry"))).alias("exits"))
    states = steps.groupBy("row").applyInPandas(chain, "row string, chunk int, state int")
    picked = walked.join(states, ["row", "chunk"])
    tail = F.element_at(F.filter("walks.exits", lambda e: e["exit"] == F.col("state")), 1)["tail"]
    picked = picked.select("row", "doc_id", "chunk", F.concat("walks.common", tail).alias("ids")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return picked.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", giant: int = 65_536, chunk: int = 16_384) -> DataFrame:
    """doc_id, ids (array<int>) of every row; documents of more than `giant` characters go through the parallel scan in chunks of `chunk`; one row has a document's ids, so they must fit one array."""
    rows = text_rows(docs, id_col, text_col)
    small = encode_small(rows.filter(F.char_length("text") <= giant), model)
    return small.unionByName(encode_giant(rows.filter(F.char_length("text") > giant), model, chunk))


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of id arrays; a null array gives an empty text."""

    def run(batches):
        library = vocabulary(model).library
        for batch in batches:
            texts = [library.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid and len(x) else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers), text_crc32 and n_chars of the decoded text."""

    def run(batches):
        library = vocabulary(model).library
        for batch in batches:
            ids = batch.column("ids")
            texts = [library.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if len(x) else "" for x in ids]
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([crc32(x.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()) for x in ids], pa.int64()),
                pa.array([crc32(t.encode()) for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "n_chars"])

    return encoded.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, n_chars long")
