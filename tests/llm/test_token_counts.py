import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orderlens.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = T.PrefixCounter(T.Vocabulary(PATH))
PIECES = ["a", "It's", " 're", "  ", "\n", " \n x", "\t", "\x1c", "\u0085", " ", " b", "é", "ñ½²Ⅷ٣", "<|endoftext|>", "😀", "***", " !!", "word", "1234", "'S", "don't", "漢字", "á"]


def wanted(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES + [" "]), max_size=25).map("".join) | st.text(max_size=60))
def test_counts_equal_library(text):
    assert COUNTER.count(text) == wanted(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([p for p in PIECES if "<" not in p] + [" "]), max_size=12).map("".join), st.integers(0, 40))
def test_every_prefix_and_budget(text, budget):
    cut = COUNTER.chunks(text)
    ends = [sum(map(len, cut[: i + 1])) for i in range(len(cut))]
    counts = [COUNTER.count(text[:e]) for e in ends]
    for n in range(len(text) + 1):
        assert T.tokens_before(COUNTER, text, ends, counts, n) == wanted(text[:n])
    kept = T.longest_within(COUNTER, text, ends, counts, budget)
    assert wanted(text[:kept]) <= budget


def test_long_texts_without_blanks():
    rng = random.Random(1)
    for text in ("x" * 5000, "".join(rng.choice("abcdefé") for _ in range(3000)), " " * 3000, "-" * 2000):
        assert COUNTER.count(text) == wanted(text)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", None), (1, "one two", "x"), (None, " b  c\n", "y"), (7, "word " * 20000, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_odd_rows(odd):
    rows = T.token_counts(odd, PATH).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert sorted(r.n_tokens for r in rows) == sorted(map(wanted, texts))
    assert sorted(r.n_bytes for r in rows) == sorted(len(t.encode()) for t in texts)
    assert all(r.over_limit == (r.n_tokens > T.LIMIT) for r in rows)
    assert T.token_counts(odd.limit(0), PATH).count() == 0


def test_truncation_from_the_table(odd):
    table = T.prefix_table(odd, PATH)
    for r in T.truncated(table, PATH, 5).collect():
        assert r.text is None or wanted(r.text) <= 5
    assert max(len(r.text or "") for r in T.truncated(table, PATH, 5).collect()) > 10


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(docs, PATH).collect()}
    assert got == {r.doc_id: wanted(r.text or "") for r in docs.collect()}
