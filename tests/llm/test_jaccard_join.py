import itertools
import re

import numpy as np
import pytest

from orderlens.llm import jaccard_join as J
from orderlens.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        whole = [tuple(w)] if w else []
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else set(whole))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None:
            continue
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None)
        out.append((d, len(sets[i]), None if d is None else low))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, J.jaccard_classes(docs).collect()), key=str)


def test_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:57] + ["x", "y", "z"]
    rows = [
        (5, " ".join(base)),
        (3, " ".join(near)),
        (9, " ".join(base).upper()),
        (9, " ".join(base).upper()),
        (1, "one two three"),
        (2, "ONE\ttwo\nthree"),
        (4, None),
        (6, ""),
        (7, " \n"),
        (None, " ".join(base)),
        (8, "É " * 8),
        (10, "é " * 8),
        (11, "long " * 30000),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int")
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == []


def test_near_copies_and_a_common_line(spark, monkeypatch):
    """Copies at the border of the threshold, and a line in a third of the documents."""
    monkeypatch.setattr(J, "HOT_LEAST", 3)
    import random

    rng = random.Random(4)
    line = " ".join(f"c{i}" for i in range(12))
    base = [f"b{i}" for i in range(80)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(80)] = f"r{rng.random()}"
        if d % 3 == 0:
            words = [f"u{d}_{i}" for i in range(rng.randint(1, 40))] + line.split()
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(docs) == brute(rows)


def test_a_line_held_once_in_each_of_many_partitions(spark, monkeypatch):
    """No partition sees a shingle twice, the sum of the sketches does."""
    monkeypatch.setattr(J, "HOT_LEAST", 100)
    line = " ".join(f"c{i}" for i in range(9))
    rows = [(d, " ".join(f"u{d // 3}_{i}" for i in range(d % 40)) + " " + line) for d in range(211)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(211, "doc_id")
    described = docs.mapInArrow(J._describe(5), J._DESCRIBED)
    counters, least = J.shingle_counters(described)
    common = J.shingle_set(line, J.WordHashes())
    own = J.shingle_set(" ".join(f"u70_{i}" for i in range(30)), J.WordHashes())
    assert (counters[common >> J._SHIFT] >= least).all() and (counters[own >> J._SHIFT] < least).all()
    assert found(docs) == brute(rows)


def test_counters_are_rounded_up_by_less_than_a_tenth():
    counts = np.array([0, 1, 2, 3, 50, 1000, 123456, 4_000_000])
    back = J.unpacked_counters(J.packed_counters(counts))
    assert (back >= counts * (1 - 1e-12)).all() and (back + 1 <= 1.1 * (counts + 1)).all()


@pytest.mark.parametrize("earlier", [1, 3, 16])
def test_a_pair_is_made_once_however_many_postings_it_shares(spark, monkeypatch, earlier):
    """A row of the join for each shared posting of each pair grew with the square of a group's size."""
    import random

    monkeypatch.setattr(J, "EARLIER", earlier)
    rng = random.Random(7)
    sets = {}
    for node in range(60):
        kept = list(range(100))
        for _ in range(rng.randint(0, 25)):
            kept[rng.randrange(100)] = 1000 + rng.randrange(100_000)
        sets[node] = np.unique(np.array(kept, np.uint64) * J._MIX)
    rows = [(int(np.int64(h)), n, len(s), i, n) for n, s in sets.items() for i, h in enumerate(s.view(np.int64)[: len(s) // 4 + 1])]
    lists = spark.createDataFrame(rows, "shingle long, node long, n int, pos int, root long")
    nodes = spark.createDataFrame([(n, J.signature(s).tolist()) for n, s in sets.items()], "node long, sign array<long>")
    made = [(r.node_a, r.node_b) for r in J._first_shared(J._with_earlier(lists, nodes), 75).collect()]
    linking = {
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if 100 * len(x := np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) and len(x)
    }
    assert linking and linking <= set(made)
    if earlier == 16:
        assert len(made) <= 1.2 * len(set(made))


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Batches of 10,000 texts were held by a task on both sides."""
    docs = spark.range(5000).coalesce(1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    key, describe, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", J._describe, spark.sparkContext.accumulator(0)
    before = spark.conf.get(key)

    def counted(size):
        run = describe(size)

        def most(batches):
            def checked():
                for batch in batches:
                    seen.add(batch.num_rows > 1000)
                    yield batch

            yield from run(checked())

        return most

    monkeypatch.setattr(J, "_describe", counted)
    assert J.jaccard_classes(docs).count() == 5000
    assert seen.value == 0 and spark.conf.get(key) == before


def test_whole_sets_are_compared_without_python(spark):
    """Batches of whole sets in Arrow took an executor's memory beyond its limit."""
    sets = [list(range(100)), list(range(14, 100)), list(range(25, 100)), list(range(26, 100)), [-5], [7]]
    rows = [(i, j, sets[i], sets[j]) for i, j in itertools.combinations(range(len(sets)), 2)]
    both = spark.createDataFrame(rows, "a long, b long, set_a array<long>, set_b array<long>")
    links = J._verified(both, 75)
    want = [(a, b) for a, b, p, q in rows if 100 * len({*p} & {*q}) >= 75 * len({*p} | {*q})]
    assert sorted(map(tuple, links.collect())) == want and (0, 2) in want and (0, 3) not in want
    assert "Arrow" not in links._jdf.queryExecution().toString()


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51)], [(1, 1)], []])
def test_components(spark, links):
    up = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in up:
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == up
