"""The audit against SQL and against plain Python; transducer and hash table against plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm import filter_audit as A
from orderlens.llm.queries import ORACLE

ALPHABET = st.lists(st.sampled_from(["a", "A", " ", "\n", "\t", "\x0b", "#", "|", "é", " ", " ", "😀", "abcdefgh", "Zürich", "x" * 70, "\0"]), max_size=30).map("".join)


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))


def measured(texts):
    data, offsets = A.laid_out(pa.array(texts, pa.string()))
    return list(zip(*(x.tolist() for x in A.measure(data, offsets))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | ALPHABET | st.text(max_size=30), max_size=8))
def test_measures_equal_plain_python(texts):
    assert measured(texts) == [plain(t or "") for t in texts]


def test_pieces_and_growth(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["w%d" % rng.randrange(4000), "Same", "y" * rng.randrange(1, 90)]) for _ in range(9000)) for _ in range(3)]
    wanted = [plain(t) for t in texts]
    assert measured(texts) == wanted
    monkeypatch.setattr(A, "PIECE", 7)
    monkeypatch.setattr(A, "SPANS", 11)
    assert measured([t[:3000] for t in texts] + ["", "a", ""]) == [plain(t[:3000]) for t in texts] + [plain(t) for t in ("", "a", "")]


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(A.SpanTable, "hashes", lambda self, start, size, text: np.zeros(len(start), np.uint64))
    assert measured(["a b c a bb b", "a a"]) == [plain("a b c a bb b"), plain("a a")]


def test_portions_hold_all_rows():
    texts = ["x" * n for n in (5, 0, 30, 2, 2, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    cut = [p.column("text").to_pylist() for p in A.portions(batch, "text", 7)]
    assert sum(cut, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 7 for p in cut)


def by_plain_python(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first, sets = {}, []
    for d, _, text in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, lang, text in docs:
        words, distinct, capitals, points, symbols = plain(text or "")
        tests = [words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, symbols > 0, d is not None and d > first[text or ""]]
        sets.append((lang or "", {c for c, t in zip("ABCDE", tests) if t}, d in good, d in toxic))
    out = {}
    for part in {s[0] for s in sets}:
        mine = [s for s in sets if s[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [s for s in left if f in s[1]]
                failing = sum(f in s[1] for s in mine)
                left = [s for s in left if f not in s[1]]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), failing - len(here), sum(s[1] == {f} for s in mine), sum(s[2] for s in here), sum(s[3] for s in here)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    words = ["apple", "Pear", "#", "kiwi", "fig", "plum|", "É", "x1", "y2", "z3"]
    texts = [" ".join(rng.choices(words[: rng.randrange(2, 10)], k=rng.choice([3, 150, 260]))) for _ in range(25)]
    texts += [None, "", " ", "Z" * 5000, "w " * 3000, " ".join(f"w{i}" for i in range(400))]
    docs = [(rng.choice([*range(60), None]), rng.choice(["en", "de", "", None]), rng.choice(texts)) for _ in range(150)]
    labels = [(rng.choice([*range(70), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    return docs, labels


def test_odd_rows_equal_plain_python(spark, odd):
    docs, labels = odd
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, lang string, text string, part string, fails int").repartition(5)
    said = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, text string")
    rows = A.filter_audit(frame, said).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) and got == by_plain_python(docs, labels)
    assert A.filter_audit(frame.limit(0), said).count() == 0
    assert A.filter_audit(frame, said.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_documents_equal_sql(spark, small):
    tables = {t: f"{small}/{t}.parquet" for t in ("documents", "labels")}
    db = duckdb.connect()
    for name, path in tables.items():
        db.execute(f"CREATE VIEW {name} AS FROM '{path}'")
    rows = A.filter_audit(*map(spark.read.parquet, tables.values()))
    names = sorted(rows.columns)
    assert sorted(map(tuple, rows.select(names).collect())) == sorted(db.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op11_filter_audit']})").fetchall())
