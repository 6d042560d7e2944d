import hashlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm import piece_codec as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = C.Pieces(MODEL)
PARTS = ["a", "the ", "  ", "\n", "\t", "é", "▁", "▁▁x", "<s>", "</s>", "<0x41>", "\x00", "ﬁ", "漢字", "😀", "á", "ing", "!!!", " "]


def coded(text):
    cache = C.ChunkCache(PIECES)
    cut = C.chunks_of(text) if text else []
    cache.learn([cut])
    import numpy as np

    return np.frombuffer(C.encode_text(cut, cache), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, " "]), max_size=25).map("".join) | st.text(max_size=60))
def test_whole_texts_equal_library(text):
    ids = coded(text)
    assert ids == LIBRARY.encode(text)
    assert PIECES.decode(ids + [PIECES.end]) == LIBRARY.decode(ids + [PIECES.end])


def test_long_chunk():
    text = "abcdefghij" * 2000 + "é" * 3000
    assert coded(text) == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"etaoinshr", "é", "ing", "漢", "1"]), max_size=20).map("".join))
def test_list_and_heap_agree(word):
    assert PIECES._merged(list("▁" + word)) == PIECES._merged_by_heap(list("▁" + word))


def test_older_half_of_the_cache(monkeypatch):
    monkeypatch.setattr(C, "CACHED_CHUNKS", 3)
    cache = C.ChunkCache(PIECES)
    for text in ("one two three", "four one", "five six two", "one"):
        cut = C.chunks_of(text)
        cache.learn([cut])
        assert C.encode_text(cut, cache) == b"".join(int(i).to_bytes(4, "little") for i in LIBRARY.encode(text))
        assert len(cache) <= 4


def _check(docs):
    rows = C.digests(C.encode_decode(docs, MODEL)).collect()
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        text = LIBRARY.decode(ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, C.encoded_digests(docs, MODEL).collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", None), (1, "one two", "x"), (None, " b  c\n", "y"), (7, "word " * 20000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    _check(docs)
    _check(docs.limit(0))


def test_documents(spark, small):
    _check(spark.read.parquet(f"{small}/documents.parquet"))
