import numpy as np
import pytest

from orderlens.llm import hamming_index as H
from orderlens.llm import pivot_dedup as P

SCHEMA = "vec_id long, embedding array<float>, score string"
NAN = float("nan")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 16))
    near = base[:60] + rng.normal(scale=0.03, size=(60, 16))
    rows = [[float(x) for x in v] for v in np.vstack([base, near, base[:1], base[:1]]).astype(np.float32)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [NAN] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows + odd)] + [(None, rows[0], "x")], SCHEMA).repartition(4)


def test_neighbours_against_brute_force(vectors):
    rows, frame = vectors
    data = np.array(rows, np.float64)
    got = {}
    for r in H.nearest_neighbours(frame, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, len(rows), 20))
    hit = 0
    for q, found in got.items():
        score = data @ data[q]
        order = [i for i in np.lexsort((np.arange(len(data)), -score)) if i != q][:20]
        hit += len(set(order) & {i for i, _ in found})
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - score[i]) < 1e-9 for i, s in found)
    assert hit >= 0.9 * 20 * len(got)
    assert {461, 460} <= {i for i, _ in got[0]} or 0 not in got


def test_few_rows_and_empty_table(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.5, 1.0], ""), (2, [0.5, 1.0], "")], SCHEMA)
    got = [tuple(r) for r in H.nearest_neighbours(few).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert H.nearest_neighbours(few.limit(0)).count() == 0


def test_probing_retrieves_all_codes_within_a_radius():
    coded = np.random.default_rng(1).integers(0, 256, (500, 8)).astype(np.uint8)
    coded[100:200] = coded[:100] ^ (1 << np.random.default_rng(2).integers(0, 8, (100, 8))).astype(np.uint8)
    index = H.SubstringIndex(coded)
    for radius in (0, 7, 8, 15, 20):
        for q in coded[:30]:
            assert set(index.within(q, radius)) == set(np.flatnonzero(H.distances(q, coded) <= radius))


def test_links_against_brute_force(vectors):
    rows, frame = vectors
    data = np.array(rows, np.float64)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    linked = data @ data.T >= 0.95
    got = {r.vec_id: r for r in P.near_duplicates(frame, block=64).collect() if r.vec_id is not None}
    true = linked.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    for i in range(len(rows)):
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id <= i
    for i in range(len(rows), len(rows) + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[0].component_id == got[460].component_id == got[461].component_id == 0


def test_dedup_of_an_empty_table(vectors):
    assert P.near_duplicates(vectors[1].limit(0)).count() == 0


@pytest.mark.parametrize("pivots", [None, 202, 452, 1500])
def test_links_of_a_third_of_the_rows_that_are_distinct_near_copies(spark, pivots):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 64))
    data[::3] = data[0] + rng.normal(size=(1000, 64)) * 0.175  # a cosine of about 0.97
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(data.astype(np.float32).tolist())], SCHEMA).repartition(4)
    true = (data.astype(np.float32).astype(np.float64) @ data.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r for r in P.near_duplicates(frame, pivots=pivots, block=100).collect()}
    found = np.array([got[i].n_links for i in range(len(data))])
    assert (found <= true + 1).all() and found.sum() >= 0.9 * true.sum() and true.sum() > 900000
    assert {got[i].component_id for i in range(0, len(data), 3)} == {0}


def recalls(spark, data, **settings):
    """Share of the true 20 neighbours found, and rows found, per query."""
    data = data.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(data.tolist())], SCHEMA).repartition(4)
    found = {i: set() for i in range(0, len(data), 20)}
    for r in H.nearest_neighbours(frame, every=20, **settings).collect():
        found[r.query_id].add(r.vec_id)
    score = data[::20] @ data.T
    score[np.arange(len(score)), np.arange(0, len(data), 20)] = -np.inf
    true = np.argsort(-score, axis=1)[:, :20]
    return np.array([len(found[20 * k] & set(t)) / 20 for k, t in enumerate(true)]), np.array([len(f) for f in found.values()])


@pytest.fixture(scope="module")
def crowded():
    rng = np.random.default_rng(6)
    data = rng.normal(size=(6000, 64))
    data[::3] = data[0] + rng.normal(size=(2000, 64)) * 0.175
    return data / np.linalg.norm(data, axis=1, keepdims=True)


@pytest.mark.parametrize("candidates", [5, 50, 2500])
def test_recall_beside_a_crowd_for_any_share_of_candidates(spark, crowded, candidates):
    hit, _ = recalls(spark, crowded, candidates=candidates)
    assert hit[::3].mean() >= 0.9 and np.delete(hit, np.s_[::3]).mean() >= 0.9


def test_every_query_finds_as_many_rows_as_are_wanted(spark, crowded):
    _, rows = recalls(spark, crowded, candidates=2)
    assert set(rows) == {20}


def test_recall_with_unequal_lengths(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(8000, 64)) * rng.lognormal(0, 0.7, size=(8000, 1))
    hit, _ = recalls(spark, data, candidates=400)
    assert hit.mean() >= 0.9
