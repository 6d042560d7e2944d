"""Alignment against both libraries over whole texts and a plain comparison of all byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from orderlens.llm import token_alignment as T

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
CODE = T.Coder(*PATHS)
A, B = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
PIECES = ["a", "It's", " 're", "  ", "\n", " \n x", "\t", "\x1c", "\u0085", " ", " b", "é", "ñ½²", "<|endoftext|>", "</s>", "<0x41>", "😀", "***", " !!", "word", "1234", "漢字", "▁", "x.\nY"]
TEXTS = st.lists(st.sampled_from(PIECES + [" "]), max_size=25).map("".join) | st.text(max_size=40)


def plain(text):
    """(ids of A, ids of B, groups, links) of a text, by whole-text encoding and comparison of all ranges."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelt = (" " + text).encode()
    for ids, names in ((a, CODE.bytes_a), (b, CODE.bytes_b)):
        if b"".join(names[i] for i in ids) != spelt:
            return [], [], [], []
    ranges = []
    for ids, names in ((a, CODE.bytes_a), (b, CODE.bytes_b)):
        ends = np.cumsum([len(names[i]) for i in ids]).tolist()
        ranges.append(list(zip([0] + ends, ends)))
    common = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    groups = [tuple([i for i, (s, e) in zip(ids, r) if low <= s and e <= high] for ids, r in zip((a, b), ranges)) for low, high in zip([0] + common, common)]
    links = [(i, j) for i, (s, e) in zip(a, ranges[0]) for j, (u, v) in zip(b, ranges[1]) if s < v and u < e]
    return a, b, groups, links


def wanted(texts):
    rows = [plain(t) for t in texts]
    counts = Counter(link for r in rows for link in r[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    for a, b, groups, links in rows:
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        yield len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if a else ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXTS, min_size=1, max_size=4))
def test_facts_equal_whole_text_encoding(texts):
    facts, edges, pairs, times = T.align(CODE, [t or "" for t in texts])
    got = list(zip(*(list(f) for f in facts)))
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, (*w[:4], w[6]))) for w in wanted(texts)]
    for i, text in enumerate(texts):
        links = Counter(x * len(CODE.bytes_b) + y for x, y in plain(text)[3])
        assert links == dict(zip(pairs[edges[i] : edges[i + 1]].tolist(), times[edges[i] : edges[i + 1]].tolist()))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 300)), st.sets(st.integers(1, 300)), st.integers(1, 9))
def test_gallop_ranks(short, long, lanes):
    short, long = (np.array(sorted(x), np.int64) for x in (short, long))
    assert T.gallop(short, long, lanes).tolist() == np.searchsorted(long, short).tolist()


def test_gallop_over_far_places():
    rng = np.random.default_rng(1)
    long = np.cumsum(rng.integers(1, 9, 200_000))
    short = np.sort(rng.choice(long[-1], 500, replace=False))
    assert T.gallop(short, long, 3).tolist() == np.searchsorted(long, short).tolist()


def test_cache_in_two_halves(monkeypatch):
    monkeypatch.setattr(T, "CACHED", 50)
    code, rng = T.Coder(*PATHS), random.Random(4)
    for _ in range(6):
        texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(12)) for _ in range(4)] + ["y" * 500]
        assert [len(a) // 4 for a, _ in code.encode(texts)] == [len(plain(t)[0]) for t in texts]
        assert len(code.newer) <= 60


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PIECES + [" ", " the", " of"], k=rng.randrange(1, 40))) for _ in range(60)]
    texts += [None, "", " ", *(" ".join(rng.choices(["alpha", "beta,", "gamma"], k=9)) for _ in range(400)), "one two", "one two", "a▁b", "word " * 2000, "z" * 3000, "<|endoftext|>"]
    rows = [(i if i % 11 else None, t, 1, "x") for i, t in enumerate(texts)] + [(3, "one two", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, block long, pairs string").repartition(4)


@pytest.mark.parametrize("pairs, keys", [(T.BLOCK_PAIRS, T.BLOCK_KEYS), (1, 1)])
def test_odd_rows(odd, pairs, keys):
    rows = odd.collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, wanted([r.text for r in rows]))]
    got = [tuple(r) for r in T.token_alignment(odd, *PATHS, pairs, keys).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(odd):
    assert T.token_alignment(odd.limit(0), *PATHS).count() == 0


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 3000")
    rows = docs.collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, wanted([r.text for r in rows]))]
    assert sorted(map(tuple, T.token_alignment(docs, *PATHS).collect())) == sorted(want)
