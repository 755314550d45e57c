"""Token counts by a compiled finite-state tokenizer.

A byte-pair tokenizer with word ends is compiled to a deterministic transducer over the bytes of normalised text, each
with the class of its character (space, letter, other, digit). A state is what the rest of the text may still depend on:
the kind of the piece that is open, its last byte (which may turn out to end the word), and for each place where a
longer token may have begun, the last token up to there and how many tokens more than the surest place it has. A
transition's weight is the number of tokens that become certain. Two tokens can stand side by side exactly if no merge
crosses their border before it is closed, so the last token up to each place follows from places before it. States and
transitions are compiled when a text first needs them and kept in one hash table, which NumPy walks with many chunks
of text at a time.

Chunks meet by their state maps (entry state -> exit state, tokens). After white space the entry is the start
state. Elsewhere the map is made for every state that a piece begun in the last bytes before can be in; maps compose,
and a prefix scan gives each chunk its entry and the tokens before it. A true entry that a map lacks is added to it and
the scan repeated, so counts are exact for any text. Documents above `giant` characters are cut where normalisation
cannot reach across, and scanned in Spark: runs of chunks first, then the runs.

Defined results: null text counts as empty (0 tokens); null and repeated ids stay, a row each; special tokens in a text
count one, as the library has it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint, slices, sums, text_rows
from strophe.llm.token_files import words_apart

SPACE, LETTER, OTHER, DIGIT = range(4)
#: Kinds of open pieces: none, a run of one class, an apostrophe that may begin a contraction, the same with the first of two letters.
START, APOSTROPHE = 0, 4
#: Contractions that the pre-tokenizer cuts off. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Symbols of a lane, symbols before a cut from which its entry states are guessed, states that are kept.
STEP, LOOK_BACK, STATES_KEPT = 256, 64, 250_000
#: With so many tokens below a place or fewer, it is looked up whether any of them can follow.
FEW = 64
#: Chunks whose maps are composed before the scan.
RUN = 64
BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
#: White space below U+0250 but the space. Fixed values.
WHITE = "\t\n\x0b\x0c\r\x85\xa0"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else the next free one above 255."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        declared = json.loads(self.library.to_str())
        self.suffix = declared["model"].get("end_of_word_suffix")
        if not words_apart(declared) or not self.suffix:
            raise ValueError("this tokenizer's declaration cannot be compiled")
        special = sorted((t["content"] for t in declared.get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.longest_special = max(map(len, special), default=0)
        self.classes = np.full(0x110000, 255, np.uint8)
        self.learn(declared["model"])
        self.clear()

    # compilation

    def learn(self, model: dict) -> None:
        """Merges by rank, and a trie of all tokens with those inside words and those at word ends."""
        byte_of, vocab = byte_letters(), model["vocab"]
        self.merges = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(model["merges"])}
        self.made = {vocab[a + b]: (i, vocab[a], vocab[b]) for i, (a, b) in enumerate(model["merges"])}
        self.child: dict[int, int] = {}
        self.inside: dict[int, int] = {}
        self.ending: dict[int, int] = {}
        for token, i in vocab.items():
            ends = token.endswith(self.suffix)
            node = 0
            for c in token.removesuffix(self.suffix) if ends else token:
                node = self.child.setdefault(node << 8 | byte_of[c], len(self.child) + 1)
            (self.ending if ends else self.inside)[node] = i
        self.beside: dict[tuple[int, int], bool] = {}
        # tokens at or below each node, from the deepest node up; None where there are more than FEW
        parent = {below: at >> 8 for at, below in self.child.items()}
        own: dict[int, list[int]] = {}
        for ends in (self.inside, self.ending):
            for node, token in ends.items():
                own.setdefault(node, []).append(token)
        self.below: dict[int, list[int] | None] = {}
        for node in range(len(parent), 0, -1):
            held = self.below.setdefault(node, [])
            up = self.below.setdefault(parent[node], [])
            if held is None or up is None or len(held) + len(own.get(node, ())) + len(up) > FEW:
                self.below[parent[node]] = None
            else:
                up += own.get(node, [])
                up += held
        self.open_ends: dict[tuple[int, int], bool] = {}

    def leads(self, node: int, last: int) -> bool:
        """Whether some token below the node fits the token before it; taken for granted where there are many."""
        found = self.open_ends.get((node, last))
        if found is None:
            tokens = self.below[node]
            found = self.open_ends[node, last] = tokens is None or any(self.fits(last, t) for t in tokens)
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b (or the word's begin, -1, and b) can stand side by side: no merge across their border comes before it is closed."""
        if a < 0:
            return True
        found = self.beside.get((a, b))
        if found is None:
            found = self.beside[a, b] = self.border(a, b)
        return found

    def border(self, a: int, b: int) -> bool:
        """Undo the merges inside a and b, last first, and look at the two symbols that touch at each time; of merges of one rank the left one came first."""
        before = float("inf")
        while True:
            rank = self.merges.get((a, b))
            if rank is not None and rank < before:
                return False
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                before, a = left[0], left[2]
            else:
                before, b = right[0] + 0.5, right[1]

    def clear(self) -> None:
        self.beside.clear()
        self.open_ends.clear()
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.bits = 16
        self.table(self.bits)
        self.intern((START, 0, ()))

    def table(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def intern(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found

    def grow(self, live: tuple, byte: int) -> tuple[tuple, int]:
        """The open piece with one byte more inside it, and the tokens that are certain now."""
        found, at = [], None
        for node, last, n in live:
            below = self.child.get(node << 8 | byte)
            if below is not None:
                if self.leads(below, last):
                    found.append((below, last, n))
                token = self.inside.get(below)
                if at is None and token is not None and self.fits(last, token):
                    at = (0, token, n + 1)
        found.append(at)
        sure = min(n for _, _, n in found)
        return tuple((node, last, n - sure) for node, last, n in found), sure

    def finish(self, live: tuple, byte: int) -> int:
        """Tokens that become certain when this byte ends the piece."""
        for node, last, n in live:
            below = self.child.get(node << 8 | byte)
            token = None if below is None else self.ending.get(below)
            if token is not None and self.fits(last, token):
                return n + 1
        raise AssertionError("every byte is a token")

    def piece(self, text: bytes) -> int:
        live, total = ((0, -1, 0),), 0
        for byte in text[:-1]:
            live, n = self.grow(live, byte)
            total += n
        return total + self.finish(live, text[-1])

    @staticmethod
    def begin(kind: int, byte: int) -> tuple:
        if kind == SPACE:
            return (START, 0, ())
        if kind == OTHER and byte == ord("'"):
            return (APOSTROPHE, 0, ())
        return (kind, byte, ((0, -1, 0),))

    def move(self, state: tuple, kind: int, byte: int) -> tuple[tuple, int]:
        """The state after a byte of a character of class `kind`, and the tokens emitted."""
        open_kind, last, live = state
        if open_kind == START:
            return self.begin(kind, byte), 0
        if open_kind < APOSTROPHE:
            if 0x80 <= byte < 0xC0 or kind == open_kind != DIGIT:
                live, n = self.grow(live, last)
                return (open_kind, byte, live), n
            return self.begin(kind, byte), self.finish(live, last)
        held = chr(last) if last else ""
        so_far = held + chr(byte)
        if kind == LETTER and so_far in CONTRACTIONS:
            return (START, 0, ()), self.piece(("'" + so_far).encode())
        if kind == LETTER and not held and any(c.startswith(so_far) for c in CONTRACTIONS):
            return (APOSTROPHE, byte, ()), 0
        if held:
            state, n = self.move(self.begin(LETTER, last), kind, byte)
            return state, n + self.piece(b"'")
        if kind == OTHER:
            return self.move((OTHER, ord("'"), ((0, -1, 0),)), kind, byte)
        return self.begin(kind, byte), self.piece(b"'")

    # walking

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or the free place where it belongs."""
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        held = self.keys[at]
        off = np.flatnonzero((held != keys) & (held != -1))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[off]]
            off = off[(held != keys[off]) & (held != -1)]
        return at

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keep new transitions; of those that would take one place the last is kept, and the others look on."""
        if 3 * (self.used + len(keys)) > 1 << self.bits:
            full = self.keys != -1
            keys, values = np.concatenate((self.keys[full], keys)), np.concatenate((self.values[full], values))
            self.table(int(3 * len(keys)).bit_length() + 1)
        self.used += len(keys)
        while len(keys):
            at = self.slots(keys)
            self.keys[at] = keys
            taken = self.keys[at] == keys
            self.values[at[taken]] = values[taken]
            keys, values = keys[~taken], values[~taken]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states << 10 | symbols
        at = self.slots(keys)
        new = self.keys[at] != keys
        if new.any():
            wanted = np.unique(keys[new])
            values = []
            for key in wanted.tolist():
                state, n = self.move(self.states[key >> 10], key >> 8 & 3, key & 255)
                values.append(self.intern(state) << 16 | n)
            self.put(wanted, np.array(values, np.int64))
            at = self.slots(keys)
        found = self.values[at]
        return found >> 16, found & 0xFFFF

    def walk(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray, emitted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens of lanes of symbols, all a symbol further at a time; `emitted` gets the tokens at their places."""
        order = np.argsort(-sizes, kind="stable")
        first, left, q, total = starts[order], -sizes[order], states[order].astype(np.int64), np.zeros(len(order), np.int64)
        for i in range(-left[0] if len(left) else 0):
            live = int(np.searchsorted(left, -i))
            where = first[:live] + i
            q[:live], n = self.step(q[:live], symbols[where])
            total[:live] += n
            if emitted is not None:
                emitted[where] = n
        exits, counts = np.empty_like(q), np.empty_like(total)
        exits[order], counts[order] = q, total
        return exits, counts

    # texts

    def normal(self, text: str) -> str:
        """As the library normalises, but that spaces may be repeated; below U+0250 nothing composes, and every letter is lowered by itself."""
        if BEYOND_LATIN.search(text):
            return self.library.normalizer.normalize_str(text)
        for c in WHITE:
            text = text.replace(c, " ")
        return text.lower()

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points, by the library's own pre-tokenizer where they are new: what joins a letter, what joins a symbol, what joins neither."""
        if (self.classes[points] == 255).any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[self.classes[points] == 255]).tolist():
                joins = [len(cut(before + chr(c))) for before in "a!"]
                self.classes[c] = SPACE if c == 32 else LETTER if joins[0] == 1 else OTHER if joins[1] == 1 else DIGIT
        return self.classes[points]

    def symbols(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (class and byte) of normalised parts, a space after each, and where each part ends, its space included."""
        joined = " ".join(parts) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        widths = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        found = np.frombuffer(joined.encode(), np.uint8).astype(np.int64) | np.repeat(self.classify(points).astype(np.int64), widths) << 8
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        return found, ends

    def entries(self, symbols: np.ndarray, cut: int, low: int = 0) -> np.ndarray:
        """States that the text before a cut can be in: the true one after a space close by, else those of pieces begun at each of the places before it."""
        near = max(low, cut - LOOK_BACK)
        spaces = np.flatnonzero(symbols[near:cut] == 32)
        if len(spaces):
            starts = np.array([near + spaces[-1] + 1])
        elif near == 0:
            starts = np.array([0])
        else:
            starts = np.arange(near, cut)
        return np.unique(self.walk(symbols, starts, cut - starts, np.zeros(len(starts), np.int64))[0])

    def lanes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where lanes start, and whether each starts after a space; runs without a space for a whole step are cut anywhere."""
        spaces = np.flatnonzero(symbols == 32)
        targets = np.arange(STEP, len(symbols), STEP)
        after = spaces[np.minimum(np.searchsorted(spaces, targets), len(spaces) - 1)] + 1
        hard = targets[after - targets > STEP]
        soft = np.unique(np.concatenate(([0], after[after < len(symbols)])))
        starts = np.unique(np.concatenate((soft, hard)))
        return starts, np.isin(starts, soft)

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens at the symbols where they become certain; those of a lane without a known entry all stand at its start."""
        emitted = np.zeros(len(symbols), np.int64)
        starts, soft = self.lanes(symbols)
        sizes = np.diff(np.append(starts, len(symbols)))
        exits = np.zeros(len(starts), np.int64)
        exits[soft] = self.walk(symbols, starts[soft], sizes[soft], np.zeros(soft.sum(), np.int64), emitted)[0]
        hard = np.flatnonzero(~soft)
        guesses = [self.entries(symbols, int(starts[i])) for i in hard]
        which = np.repeat(hard, [len(g) for g in guesses])
        entry = np.concatenate([*guesses, np.zeros(0, np.int64)]).astype(np.int64)
        out, n = self.walk(symbols, starts[which], sizes[which], entry)
        maps = {(i, e): (x, t) for i, e, x, t in zip(which.tolist(), entry.tolist(), out.tolist(), n.tolist(), strict=True)}
        for i in hard.tolist():
            e = int(exits[i - 1])
            if (i, e) not in maps:
                x, t = self.walk(symbols, starts[i : i + 1], sizes[i : i + 1], np.array([e]))
                maps[i, e] = (int(x[0]), int(t[0]))
            exits[i], emitted[starts[i]] = maps[i, e]
        return emitted

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts."""
        if len(self.states) > STATES_KEPT:
            self.clear()
        parts, owner = [], []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if "<|" in text else [text]
            counts[i] = len(pieces) - 1
            parts += [self.normal(p) for p in pieces]
            owner += [i] * len(pieces)
        if parts:
            # a space leads to the start state from any other, so the different words of all texts are walked once
            lists = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
            coded = lists.values.dictionary_encode()
            symbols, ends = self.symbols(coded.dictionary.to_pylist())
            total = np.concatenate(([0], np.cumsum(self.emissions(symbols))))
            of_word = np.diff(np.concatenate(([0], total[ends])))
            in_part = sums(of_word[coded.indices.to_numpy(zero_copy_only=False)], lists.offsets.to_numpy())
            counts += np.bincount(owner, in_part, len(texts)).astype(np.int64)
        return counts

    # chunks of giant texts

    def chunk_symbols(self, text: str) -> tuple[np.ndarray, int]:
        """Symbols of a part of a document and the number of special tokens in it; a special token ends what is open."""
        pieces = self.special.split(text)
        symbols = self.symbols([self.normal(p) for p in pieces])[0]
        return symbols[:-1], len(pieces) - 1

    def chunk_map(self, before: str, text: str, last: bool, entries: list[str] | None = None) -> list[tuple[str, str, int]]:
        """(entry state, exit state, tokens) of a chunk for these entries, or for all that the text before it suggests."""
        symbols, extra = self.chunk_symbols(text)
        if last:
            symbols = np.append(symbols, 32)
        if entries is None:
            own = self.entries(x := self.chunk_symbols(before)[0], len(x), 1) if before else np.zeros(1, np.int64)
        else:
            own = np.array([self.intern(loaded(e)) for e in entries], np.int64)
        exits, n = self.walk(symbols, np.zeros(len(own), np.int64), np.full(len(own), len(symbols)), own) if len(symbols) else (own, np.zeros(len(own), np.int64))
        return [(dumped(self.states[e]), dumped(self.states[x]), int(t) + extra) for e, x, t in zip(own.tolist(), exits.tolist(), n.tolist(), strict=True)]


def dumped(state: tuple) -> str:
    return json.dumps(state)


def loaded(text: str) -> tuple:
    kind, last, live = json.loads(text)
    return kind, last, tuple(map(tuple, live))


#: The state at the begin of every text.
BEGIN = dumped((START, 0, ()))


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def closed_before(c: str) -> bool:
    """Whether no normal form joins this character to one before it: it is no mark and no part of a Hangul syllable."""
    return c < "\x80" or not (unicodedata.category(c).startswith("M") or unicodedata.combining(c) or "ᅠ" <= c <= "ᇿ")


def cuts(text: str, chunk: int, special: re.Pattern, longest: int) -> list[int]:
    """Where a text is cut: at most `chunk` characters apart after white space if there is some in the second half, else between any characters that no normal form and no special token joins."""
    found, at = [0], 0
    while len(text) - at > chunk:
        places = [m.end() for m in re.finditer(r"\s", text[at + chunk // 2 : at + chunk])]
        for place in [at + chunk // 2 + p for p in reversed(places)] + list(range(at + chunk, len(text))):
            near = max(0, place - longest)
            if closed_before(text[place : place + 1]) and not any(near + m.start() < place < near + m.end() for m in special.finditer(text[near : place + longest])):
                break
        else:
            break
        at = place
        found.append(at)
    return found


def composed(maps: list[dict[str, tuple[str, int]]]) -> dict[str, tuple[str, int]]:
    """One map for maps in a row; an entry goes where all of them know it."""
    total = maps[0]
    for after in maps[1:]:
        total = {e: (after[x][0], n + after[x][1]) for e, (x, n) in total.items() if x in after}
    return total


def scanned(maps: list[dict[str, tuple[str, int]]], entry: str | None, before: int) -> list[tuple[str | None, int]]:
    """Entry state and tokens before each map and after the last; None where a map lacks the entry before."""
    found = [(entry, before)]
    for own in maps:
        entry, n = own.get(entry, (None, 0)) if entry is not None else (None, 0)
        before += n
        found.append((entry, before))
    return found


def by_place(group: pd.DataFrame, place: str) -> tuple[list[int], list[dict[str, tuple[str, int]]]]:
    found: dict[int, dict[str, tuple[str, int]]] = {}
    for at, entry, left, n in zip(group[place], group["entry"], group["left"], group["n"], strict=True):
        found.setdefault(at, {})[entry] = (left, n)
    return sorted(found), [found[k] for k in sorted(found)]


def frame(group: pd.DataFrame, **columns: list) -> pd.DataFrame:
    """Rows of a group's document; as objects, as empty columns and missing states else become chunked arrays, which Spark does not take."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in ({"row": [group["row"].iloc[0]] * n} | columns).items()})


MAP = "row string, chunk int, entry string, left string, n long"


def chunk_starts(rows: DataFrame, path: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Of giant documents (row, doc_id, text): their sizes (row, doc_id, n_bytes), and for each chunk (row, chunk, entry, before): its entry state and the tokens before it; the last row of each document is its end."""

    def cut(batches):
        own = transducer(path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                starts = cuts(text, chunk, own.special, own.longest_special)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)):
                    head = next((p for p in range(max(0, a - 4 * LOOK_BACK), a) if closed_before(text[p])), a)
                    cells = [[row], [doc_id], [i], [text[head:a]], [text[a:b]], [b == len(text)], [len(text[a:b].encode())]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["row", "doc_id", "chunk", "head", "part", "last", "n_bytes"])

    parts = rows.mapInArrow(cut, "row string, doc_id long, chunk int, head string, part string, last boolean, n_bytes long")
    parts = checkpoint(parts.repartition("row", "chunk"))

    def maps(batches):
        own = transducer(path)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "chunk", "head", "part", "last", "wanted")]
            found = [(row, i, *m) for row, i, head, part, last, wanted in zip(*columns, strict=True) for m in own.chunk_map(head, part, last, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["row", "chunk", "entry", "left", "n"])

    def one_map(group: pd.DataFrame) -> pd.DataFrame:
        total = composed(by_place(group, "chunk")[1])
        return frame(group, run=[int(group["run"].iloc[0])] * len(total), entry=list(total), left=[x for x, _ in total.values()], n=[n for _, n in total.values()])

    def scan_runs(group: pd.DataFrame) -> pd.DataFrame:
        places, own = by_place(group, "run")
        states = scanned(own, BEGIN, 0)[:-1]
        return frame(group, run=places, start=[e for e, _ in states], before=[n for _, n in states])

    def scan_chunks(group: pd.DataFrame) -> pd.DataFrame:
        places, own = by_place(group, "chunk")
        states = scanned(own, group["start"].iloc[0], int(group["before"].iloc[0]))
        return frame(group, chunk=[*places, places[-1] + 1], entry=[e for e, _ in states], before=[n for _, n in states])

    fields = parts.select("row", "chunk", "head", "part", "last")
    known = checkpoint(fields.withColumn("wanted", F.lit(None).cast("array<string>")).mapInArrow(maps, MAP))
    while True:
        dealt = known.withColumn("run", F.floor(F.col("chunk") / RUN).cast("int"))
        runs = dealt.groupBy("row", "run").applyInPandas(one_map, "row string, run int, entry string, left string, n long")
        # a run that knows no whole way still takes its place, so that what follows is not read as its neighbour
        runs = runs.unionByName(dealt.select("row", "run").distinct().select("row", "run", F.lit("").alias("entry"), F.lit("").alias("left"), F.lit(0).cast("long").alias("n")))
        starts = runs.groupBy("row").applyInPandas(scan_runs, "row string, run int, start string, before long")
        states = checkpoint(dealt.join(starts, ["row", "run"]).groupBy("row", "run").applyInPandas(scan_chunks, "row string, chunk int, entry string, before long"))
        lacking = [states.filter("entry is not null").select("row", "chunk", "entry"), known.select("row", F.col("chunk") + 1, F.col("left"))]
        holes, exits = (x.toDF("row", "chunk", "entry").join(known, ["row", "chunk", "entry"], "left_anti").join(fields, ["row", "chunk"]) for x in lacking)
        if holes.isEmpty():
            break
        # with the entry that the scan lacks come all that the chunk before can leave, as the next scan may lack those
        holes = holes.unionByName(exits).distinct()
        more = checkpoint(holes.select("row", "chunk", "head", "part", "last", F.array("entry").alias("wanted")).mapInArrow(maps, MAP))
        known = known.unionByName(more)
    # the last chunk of a run also gives the first place of the next one
    states = states.groupBy("row", "chunk").agg(F.max("entry").alias("entry"), F.max("before").alias("before"))
    return parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes")), states


def count_tokens(docs: DataFrame, path: str, limit: int = 2_048, id_col: str = "doc_id", text_col: str = "text", giant: int = 1 << 20, chunk: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row; texts of more than `giant` characters are counted in chunks of about `chunk`."""

    def run(batches):
        own = transducer(path)
        for batch in slices(batches):
            texts = batch.column("text")
            n = own.count(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = text_rows(docs, id_col, text_col)
    size = F.char_length("text")
    counted = rows.filter(size <= giant).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    large = checkpoint(rows.filter(size > giant).select(F.expr("uuid()").alias("row"), "doc_id", "text"))
    if not large.isEmpty():
        sizes, states = chunk_starts(large, path, chunk)
        totals = sizes.join(states.groupBy("row").agg(F.max("before").alias("n_tokens")), "row")
        counted = counted.unionByName(totals.select("doc_id", "n_bytes", "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
