import math
import re

from orderlens.llm import mixing as M


def test_targets_by_water_level(spark):
    rows = [("a", 100), ("b", 10), ("c", 400), (None, 50), ("d", 0)]
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(rows, "source string, words long")).collect()}
    order, weights = ["a", "b", "c", "d", None], dict(zip(["a", "b", "c", "d", None], [3.0, 1.0, 2.0, 3.0, 1.0]))
    words = dict(rows)
    want, capped = {}, set()
    while True:
        left = 840.0 - sum(2 * words[s] for s in capped)
        rest = [s for s in order if s not in capped]
        total = sum(weights[s] for s in rest)
        want = {s: 2.0 * words[s] if s in capped else left * weights[s] / total for s in order}
        over = {s for s in rest if want[s] > 2 * words[s]}
        if not over:
            break
        capped |= over
    assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in order)


def test_rates_solve_the_dual(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = M.mixture(docs).toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (rows["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows["text"]]).all()
    assert set(rows["copies"]) <= {0, 1, 2} and (rows["taken"] == rows["copies"] * rows["size"]).all()
    for _, g in rows.groupby("source", dropna=False):
        target = g["target"].iloc[0]
        assert math.isclose((g["rate"] * g["size"]).sum(), target, rel_tol=1e-6)
        assert abs(g["taken"].sum() - target) <= g["size"].max()
        free = g[(g["rate"] < 2) & (g["size"] > 0)]
        tilt = [math.log(r) / s for r, s in zip(free["rate"], free["size"])]
        assert not len(tilt) or max(tilt) - min(tilt) < 1e-9


def test_odd_rows(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 20000, None), (4, "x " * 20000, None), (None, "one", "s")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    out = M.mixture(docs)
    assert out.count() == 6 and all(r.taken <= 2 * r.size for r in out.collect())
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, M.mixture(docs).collect()), key=str)
    again = M.repeated(docs)
    assert again.columns == docs.columns
    assert M.mixture(docs.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
