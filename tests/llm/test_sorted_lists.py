"""Top scores against brute force, with ties, copies, hot groups, odd vectors and several blocks."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from orderlens.llm import sorted_lists as S
from orderlens.llm.queries import ORACLE

KIND = "vec_id long, embedding array<double>"


def brute(rows, every, wanted, scale=256):
    known = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = np.floor(scale * np.array(v, np.float64)).astype(np.int64)
        known[i] = min(known.get(i, whole), whole, key=lambda w: w.tobytes())
    out = []
    for q in (i for i in known if i % every == 0):
        scores = [(-int(known[q] @ known[i]), i) for i in known if i != q and len(known[i]) == len(known[q])]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:wanted], 1)]
    return sorted(out)


def found(spark, rows, every=5, wanted=4, **more):
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    return sorted(map(tuple, S.top_scores(frame, every, wanted, **more).collect()))


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(-30, 90)]
    rows += [(i, [0.25] * 6) for i in range(100, 160)]  # a hot group of equal vectors
    rows += [(i, (0.3 + 0.01 * rng.normal(size=6)).tolist()) for i in range(160, 220)]  # near copies
    rows += [(300, [0.0] * 6), (301, None), (305, []), (310, [float("nan")] * 6), (315, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("inf")] * 6)]
    rows += [(7, [9.0] * 6), (7, [9.0] * 6), (10, [-3.0] * 6), (None, [1.0] * 6)]
    rows += [(400, [1.0, 2.0]), (405, [-1.0, 0.5]), (410, [5000.0, 2e5]), (415, [1.0])]
    return rows


@pytest.mark.parametrize("more", [{}, {"block": 16}, {"block": 40, "piece_rows": 7}])
def test_odd_rows(spark, odd, more):
    assert found(spark, odd, **more) == brute(odd, 5, 4)


def test_few_candidates_and_no_rows(spark, odd):
    assert found(spark, odd[:3], 1, 9) == brute(odd[:3], 1, 9)
    assert found(spark, [(5, [1.0])], 1, 9) == []
    assert S.top_scores(spark.createDataFrame([], KIND)).count() == 0


def test_huge_components_do_not_fail(spark):
    rows = [(i, [1e300, -1e300, float(i)]) for i in range(6)]
    assert len(found(spark, rows, 1, 2)) == 12


def test_extra_columns(spark, odd):
    frame = spark.createDataFrame([(*r, 1, "x") for r in odd], KIND + ", score int, rank string")
    assert sorted(map(tuple, S.top_scores(frame, 5, 4).collect())) == brute(odd, 5, 4)


def block_of(ids, vectors, wanted):
    rows = pa.table({"vec_id": ids, "vector": [v.tobytes() for v in vectors]})
    row = S._listed(wanted)(rows).to_pylist()[0]
    return S.Block(row["n"], row["width"], row["ids"], row["order"], row["values"])


@pytest.mark.parametrize("spread", ["even", "uneven", "shifted", "one list"])
def test_reading_stops_early_and_finds_all(spread):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16)) * 60
    if spread == "uneven":
        vectors *= np.geomspace(1, 200, 16)
    if spread == "shifted":
        vectors += 500
    if spread == "one list":
        vectors[:, 1:] = 0
    vectors = np.floor(vectors).astype(np.int64)
    ids = np.arange(3000)
    block, read = block_of(ids, vectors, 5), []
    queries = vectors[::100]
    for i, query, places, reached in zip(ids[::100], queries, *block.pauses(queries.astype(np.float64))):
        full = vectors @ query
        order = [j for j in np.lexsort((ids, -full)) if j != i][:5]
        for floor in (-np.inf, full[order[-1]]):
            scores, who, seen = block.best(query, places, reached, i, floor, 5)
            # among equal vectors only the first ids are kept
            assert scores.tolist() == full[order].tolist() and who.tolist() == order
        read.append(seen / max(1, np.count_nonzero(query) * block.n))
    assert np.mean(read) < 0.9


def test_documents_equal_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{small}/embeddings.parquet'")
    rows = S.top_scores(spark.read.parquet(f"{small}/embeddings.parquet"))
    names = sorted(rows.columns)
    assert sorted(map(tuple, rows.select(names).collect())) == sorted(db.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op12_top_scores']})").fetchall())
