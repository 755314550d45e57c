"""The ids of a whole small table reach the best score that any cut of the whole text into pieces has."""

import public_tokenizers
import pytest

from strophe.llm import sentencepiece_scan as sps

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def best_score(text, scores, longest, unknown):
    """The best sum over all cuts of the text, without words and without chunks."""
    best = [0.0] + [-1e300] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            s = scores.get(text[start:end])
            if s is not None and best[start] + s > best[end]:
                best[end] = best[start] + s
        if text[end - 1] not in scores and best[end - 1] + unknown > best[end]:
            best[end] = best[end - 1] + unknown
    return best[-1]


@pytest.mark.parametrize("giant, chunk", [(65_536, 16_384), (500, 200)])
def test_whole_table_is_optimal(spark, giant, chunk):
    own = sps.vocabulary(MODEL)
    scores = {p: s for p, (_, s) in own.ids.items()}
    piece_of = {i: p for p, (i, _) in own.ids.items()}
    is_byte = set(own.bytes.values())
    byte_of = {i: b for b, i in own.bytes.items()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in sps.encode(df, MODEL, giant=giant, chunk=chunk).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        if not text:
            assert got[i] == []
            continue
        marked = sps.MARK + text.replace(" ", sps.MARK)
        total, back, held = 0.0, b"", b""
        for k in got[i]:
            if k in is_byte:
                held += bytes([byte_of[k]])
                continue
            total += own.unknown * len(held.decode())
            back += held + piece_of[k].encode()
            held = b""
            total += scores[piece_of[k]]
        total += own.unknown * len(held.decode())
        assert (back + held).decode() == marked
        assert total == pytest.approx(best_score(marked, scores, own.reach, own.unknown), rel=1e-9, abs=1e-4)
