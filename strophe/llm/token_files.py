"""Token-id files with a shared zstandard dictionary.

Documents are dealt to ranges of their id and sorted; each task encodes its range and writes shard files of bounded
size: a header with the dictionary's SHA-256, an index (id, number of tokens, offset of the frame) and one zstandard
frame for each document, so a short document is read and decompressed alone. The dictionary is trained on the
serialized id arrays of a bounded sample and stored once beside the shards. Files are written under a temporary name
and renamed, with the same bytes on every attempt, so a lost executor's task can run again.

Each different word of a batch is cut once into its letters, digits and symbols, in Arrow and NumPy over all words, and
the ids of these units are kept instead of encoded again. That holds for tokenizers that lower-case and cut texts as
APART says, never across white space, nor across letters, digits and symbols in plain Latin words. A file's own
declaration is compared with it when it is loaded; the texts of any other tokenizer are encoded whole.

Defined results: null text counts as empty (the end id alone); null ids come first and stay null; repeated ids are
ordered by their text; an empty table gives no shards and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from array import array
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint, slices, text_buffers, text_rows

MAGIC = b"STOK0001"
HEAD = struct.Struct("<8sB32sI")
#: Python's split() takes these for white space and the tokenizer may not, and special tokens hold this pair: such texts are encoded whole.
WHOLE = re.compile(r"[\x1c-\x1f\x85]|<\|")
#: Other texts fall apart at white space. Words of ASCII and Latin letters alone, without apostrophes (contractions), also
#: fall into runs of letters, single digits and runs of symbols, as the pre-tokenizer cuts them.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ɏ"
MIXED = re.compile(rf"[^\x00-\x7f{LETTERS}]|'")
#: The kinds of a plain word's bytes: letters (all but ASCII are), digits and symbols.
SYMBOL, LETTER, DIGIT = range(3)
KIND = np.array([LETTER if b >= 128 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else SYMBOL for b in range(256)], np.uint8)
WORDS_KEPT = 800_000
#: How a tokenizer file declares that its words are apart: normaliser and pre-tokenizer. Fixed values.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def words_apart(declared: dict) -> bool:
    """Whether a tokenizer's declaration is APART, without truncation, and its special tokens hold the pair that WHOLE looks for."""
    special = [t["content"] for t in declared.get("added_tokens") or []]
    return all(declared.get(k) == v for k, v in APART.items()) and not declared.get("truncation") and all("<|" in t for t in special)


def units_of(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The units of all words, and the number of units before each word and in all. Plain words are lower-cased and cut, mixed words are one unit as they are."""
    mixed = pc.match_substring_regex(words, MIXED.pattern)
    starts, data = text_buffers(pc.if_else(mixed, words, pc.utf8_lower(words)))
    kind = KIND[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begins[np.repeat(mixed.to_numpy(zero_copy_only=False), np.diff(starts))] = False
    begins[starts[starts < len(data)]] = True
    at = np.flatnonzero(begins)
    units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
    return units, np.searchsorted(at, starts)


@lru_cache(maxsize=2)
def word_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    apart = words_apart(json.loads(tokenizer.to_str()))
    new_half: dict[str, bytes] = {}
    old_half: dict[str, bytes] = {}
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    is_end = np.zeros(max(tokenizer.get_vocab().values(), default=0) + 1, dtype=bool)
    if suffix:
        is_end[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def raw(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_plain(new: list[str]) -> list[bytes]:
        """Ids of each plain unit: many in one text, told apart by the end-of-word tokens, one in each unit."""
        out = []
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            ids = raw([" ".join(part)])[0]
            ends = 4 * (np.flatnonzero(is_end[np.frombuffer(ids, "<u4")]) + 1)
            if len(ends) == len(part):
                out += [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            else:  # a tokenizer without such tokens
                out += raw(part)
        return out

    def of_units(units: list[str]) -> list[bytes]:
        """Ids of each different unit, kept or encoded now; units still in use move on to the new half."""
        nonlocal new_half, old_half
        if len(new_half) > WORDS_KEPT // 2:
            new_half, old_half = {}, new_half
        got = list(map(new_half.get, units))
        missing = []
        for i in [i for i, x in enumerate(got) if x is None]:
            if (x := old_half.get(units[i])) is not None:
                got[i] = new_half[units[i]] = x
            else:
                missing.append(i)
        alone = {i for i in missing if MIXED.search(units[i])}
        mixed, plain = list(alone), [i for i in missing if i not in alone]
        for at, ids in ((mixed, raw([units[i] for i in mixed])), (plain, of_plain([units[i] for i in plain]))):
            for i, x in zip(at, ids, strict=True):
                got[i] = new_half[units[i]] = x
        return got

    def encode(texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; the different words of all texts are cut once, and their different units looked up once."""
        if not apart:
            return raw(texts)
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, WHOLE.pattern)
        lists = pc.ascii_split_whitespace(pc.if_else(whole, "", column))
        words = lists.values.dictionary_encode()
        cuts, first = units_of(words.dictionary)
        units = cuts.dictionary_encode()
        starts, ids = text_buffers(pa.array(of_units(units.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(units.indices))
        of_word = pa.Array.from_buffers(pa.large_binary(), len(words.dictionary), [None, pa.py_buffer(starts[first]), pa.py_buffer(ids)])
        starts, ids = text_buffers(of_word.take(words.indices))
        bounds = starts[lists.offsets].tolist()
        return [raw([t])[0] if w else ids[a:b].tobytes() for t, w, a, b in zip(texts, whole.to_pylist(), bounds, bounds[1:], strict=False)]

    return encode, tokenizer.get_vocab_size()


def narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = 512, sample_chars: int = 20_000, size: int = 65_536) -> tuple[bytes, int]:
    """The dictionary and the width of an id in bytes. Sample: the first `sample_docs` documents of at most `sample_chars` characters by the hash of their id."""
    encode, vocab = word_encoder(tokenizer)
    width = 2 if max(vocab, end_id + 1) <= 65_536 else 4
    fit = docs.filter(F.char_length("text") <= sample_chars)
    # ids first: each partition sends its best ids alone to the driver
    chosen = [r["doc_id"] for r in fit.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sample_docs).collect()]
    sample = sorted(r["text"] for r in fit.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample_docs).collect()) if chosen else []
    arrays = [narrow(ids + struct.pack("<I", end_id), width) for ids in encode(sample)]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes(), width
    except zstandard.ZstdError:  # too little to train on: its bytes serve as they are
        return b"".join(arrays)[:size], width


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    system, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def shard_bytes(rows: list[tuple[int | None, bytes]], width: int, dictionary: bytes, level: int) -> bytes:
    """rows: id and uint32 ids of each document."""
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary_of(dictionary))
    frames = [packer.compress(narrow(ids, width)) for _, ids in rows]
    ids = np.array([i or 0 for i, _ in rows], dtype="<i8")
    real = np.array([i is not None for i, _ in rows], dtype=np.uint8)
    counts = np.array([len(x) // 4 for _, x in rows], dtype="<u8")
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest(), len(rows)), ids.tobytes(), real.tobytes(), counts.tobytes(), offsets.tobytes(), *frames])


class Shard:
    """A shard's bytes with access to single documents."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, digest, self.n = HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard, or of another dictionary")
        at, self.data = HEAD.size, data
        self.ids = np.frombuffer(data, "<i8", self.n, at)
        self.real = np.frombuffer(data, np.uint8, self.n, at := at + 8 * self.n)
        self.counts = np.frombuffer(data, "<u8", self.n, at := at + self.n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, at := at + 8 * self.n).astype(np.int64)
        self.start = at + 8 * (self.n + 1)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=dictionary_of(dictionary))

    def document(self, i: int) -> np.ndarray:
        frame = self.data[self.start + self.offsets[i] : self.start + self.offsets[i + 1]]
        return np.frombuffer(self.unpacker.decompress(frame), "<u2" if self.width == 2 else "<u4").astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = 32 << 20, level: int = 3) -> DataFrame:
    """Write the table's shards into the folder (a URI that all executors reach); returns shard, n_docs, n_tokens of each."""
    rows = text_rows(docs, id_col, text_col)
    dictionary, width = train_dictionary(rows, tokenizer, end_id)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    put(f"{folder}/dictionary", dictionary)
    end = struct.pack("<I", end_id)

    def run(batches):
        encode, _ = word_encoder(tokenizer)
        part, number, held, chars = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal number, held, chars
            name = f"{part:06d}-{number:06d}"
            put(f"{folder}/{name}.tok", shard_bytes(held, width, dictionary, level))
            row = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(held)], "n_tokens": [sum(len(x) // 4 for _, x in held)]})
            number, held, chars = number + 1, [], 0
            return row

        for batch in slices(batches, limit=min(4 << 20, shard_chars)):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            coded = encode(texts)
            held += [(i, c + end) for i, c in zip(ids, coded, strict=True)]
            chars += sum(map(len, texts))
            if chars >= shard_chars:
                yield close()
        if held:
            yield close()

    return checkpoint(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard string, n_docs long, n_tokens long"))


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """shard, doc_id, shard_start (ids of the shard's documents before it), n_tokens, ids_crc32 and, if wanted, ids of every document in the folder."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/dictionary") as f:
        dictionary = f.read()

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(data.as_py(), dictionary)
                starts = np.concatenate(([0], np.cumsum(shard.counts)))
                for at in range(0, shard.n, 512):
                    span = range(at, min(at + 512, shard.n))
                    arrays = [shard.document(i) for i in span]
                    columns = {
                        "shard": [os.path.basename(name).removesuffix(".tok")] * len(span),
                        "doc_id": pa.array([int(shard.ids[i]) if shard.real[i] else None for i in span], pa.int64()),
                        "shard_start": pa.array(starts[at : at + len(span)], pa.int64()),
                        "n_tokens": pa.array([len(a) for a in arrays], pa.int64()),
                        "ids_crc32": pa.array([crc32(a.tobytes()) for a in arrays], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "shard string, doc_id long, shard_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def with_starts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows of read() with start, the ids of all documents before it. The window runs over one row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    side = F.broadcast(starts) if shards.count() <= 10_000 else starts
    return rows.join(side, "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before", "shard_start", "shard")
