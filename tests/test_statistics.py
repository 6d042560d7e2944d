"""Rank statistics and tail probabilities against hand-computed values."""

import math

import numpy as np
import pandas as pd
import pytest

from orderlens.functions import tails
from orderlens.operators import statistics as st


def one(spark, column, **values):
    names = ", ".join(values)
    schema = ", ".join(f"{k} double" for k in values)
    assert names
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("z", [-3.5, -1.0, 0.0, 0.5, 1.96, 2.99, 3.0, 5.0, 12.0, 30.0])
def test_normal_tail(spark, z):
    want = 0.5 * math.erfc(z / math.sqrt(2))
    assert one(spark, tails.normal_sf("z"), z=z) == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize(
    "x, dof, want",
    [
        (9.487729036781154, 4, 0.05),
        (3.841458820694124, 1, 0.05),
        (7.814727903251179, 3, 0.05),
        (5.991464547107979, 2, 0.05),
        (0.0, 4, 1.0),
    ],
)
def test_chi_square_tail(spark, x, dof, want):
    got = one(spark, tails.chi2_sf("x", "dof"), x=x, dof=float(dof))
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("r", [0.001, 0.1, -0.4, 0.7, 0.95])
def test_correlation_p_closed_forms(spark, r):
    """For 1, 2 and 4 degrees of freedom the t distribution has closed forms."""
    a = abs(r)
    want = {3: 1 - 2 / math.pi * math.asin(a), 4: 1 - a, 6: 1 - a * (3 - a * a) / 2}
    for n, p in want.items():
        assert one(spark, tails.correlation_p("r", "n"), r=r, n=float(n)) == pytest.approx(p, rel=1e-8)


@pytest.mark.parametrize("n", [1e6, 1e9])
@pytest.mark.parametrize("t", [0.5, 1.2, 2.0, 6.0])
def test_correlation_p_large_samples(spark, n, t):
    r = t / math.sqrt(n - 2 + t * t)
    want = math.erfc(t / math.sqrt(2))
    assert one(spark, tails.correlation_p("r", "n"), r=r, n=n) == pytest.approx(want, rel=1e-4)


def test_correlation_p_limits(spark):
    assert one(spark, tails.correlation_p("r", "n"), r=1.0, n=10.0) == 0.0
    assert one(spark, tails.correlation_p("r", "n"), r=0.0, n=10.0) == pytest.approx(1.0)
    assert one(spark, tails.correlation_p("r", "n"), r=0.5, n=2.0) is None


def log_integral(log_density, width, steps=200_000):
    """Logarithm of the integral of exp(log_density(x)) over 0..width, by Simpson's rule."""
    x = np.linspace(0, width, steps + 1)
    weights = np.where(np.arange(steps + 1) % 2, 4.0, 2.0)
    weights[[0, -1]] = 1
    logs = log_density(x)
    return logs.max() + np.log((weights * np.exp(logs - logs.max())).sum() * width / steps / 3)


@pytest.mark.parametrize("z", [-8.0, -1.0, 0.0, 2.0, 3.0, 9.0, 40.0, 300.0, 2e4])
def test_normal_log_tail(spark, z):
    density = lambda x: -((abs(z) + x) ** 2) / 2 - math.log(2 * math.pi) / 2
    tail = log_integral(density, 40 / max(1, abs(z)) if abs(z) > 3 else 14)
    want = tail if z >= 0 else np.log1p(-np.exp(tail))
    assert one(spark, tails.normal_log_sf("z"), z=z) == pytest.approx(want, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 7, 10, 101, 400])
@pytest.mark.parametrize("factor", [0.5, 1.0, 3.0, 40.0, 1e4])
def test_chi_square_log_tail(spark, dof, factor):
    x = dof * factor
    density = lambda t: (dof / 2 - 1) * np.log(x + t) - (x + t) / 2 - dof / 2 * math.log(2) - math.lgamma(dof / 2)
    want = log_integral(density, 90 if factor > 1 else 90 + 14 * dof)
    assert one(spark, tails.chi2_log_sf("x", "dof"), x=x, dof=float(dof)) == pytest.approx(want, rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("n", [5.0, 40.0, 3000.0, 9e4, 2e5, 1e7, 1e11])
@pytest.mark.parametrize("rho", [1e-6, -0.001, 0.05, -0.4, 0.9, 0.99999])
def test_correlation_log_p(spark, n, rho):
    a, half = abs(rho), (n - 4) / 2
    # over y = log of the ratio of the density to its value at rho, where it falls fast
    front = math.log(2 / math.sqrt(math.pi))
    gamma = math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2) if n < 1e5 else math.log(n / 2) / 2 - 5 / (4 * n)
    width = min(1 - a, 60 / max(1.0, half * 2 * a / (1 - a * a)), 14 / math.sqrt(n) if n > 300 else 1)
    want = front + gamma + log_integral(lambda x: half * np.log1p(-((a + x) ** 2) + 1e-300), width)
    got = one(spark, tails.correlation_log_p("r", "n"), r=rho, n=n)
    assert got == pytest.approx(want, rel=1e-6, abs=2e-6)


def test_log_tails_agree_with_the_plain_ones(spark):
    for r in (0.02, 0.1, 0.3):
        p, log_p = (one(spark, f("r", "n"), r=r, n=900.0) for f in (tails.correlation_p, tails.correlation_log_p))
        assert math.exp(log_p) == pytest.approx(p, rel=1e-9)
    assert one(spark, tails.correlation_log_p("r", "n"), r=0.5, n=2.0) is None
    assert one(spark, tails.neg_log10(tails.correlation_log_p("r", "n")), r=0.0, n=9.0) == 0.0


def test_pearson_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 5), (4, 4)], "x int, y int")
    row = st.pearson_pairs(df, ["x", "y"]).collect()[0]
    assert row["n"] == 3 and row["r"] == pytest.approx(0.785714, abs=1e-6)


def test_pearson_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 2), (1, 5)], "x int, y int")
    assert st.pearson_pairs(df, ["x", "y"]).collect()[0]["r"] is None


def test_pearson_equals_numpy_under_any_nulls(spark):
    rng = np.random.default_rng(11)
    data = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 3
    data[rng.random(data.shape) < 0.3] = np.nan
    data[:, 3] = np.where(np.isnan(data[:, 0]), data[:, 3], 7.0)  # constant where the first is present
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in data]
    got = st.pearson_pairs(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect()
    assert len(got) == 6
    for row in got:
        x, y = (data[:, "abcd".index(row[k])] for k in "ab")
        both = ~np.isnan(x) & ~np.isnan(y)
        assert row["n"] == both.sum()
        if {row["a"], row["b"]} == {"a", "d"}:
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-12)


def test_pearson_far_from_zero(spark):
    df = spark.range(1000).selectExpr("id + 1e13 as x", "id * id as y")
    with pytest.raises(Exception, match="pass centers"):
        st.pearson_pairs(df, ["x", "y"]).collect()
    row = st.pearson_pairs(df, ["x", "y"], {"x": 1e13}).collect()[0]
    assert row["r"] == pytest.approx(np.corrcoef(np.arange(1000), np.arange(1000) ** 2)[0, 1], abs=1e-10)


def test_pearson_explodes_no_rows(spark):
    df = spark.range(1000).selectExpr("id as x", "id * id as y", "id % 7 as z")
    text = st.pearson_pairs(df, ["x", "y", "z"])._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate") < text.rindex("HashAggregate(keys=[held") and text.count("Generate") == 1


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (2, 1), (5, 0)], "x int, y int")
    row = st.spearman(df, ["x"], "y").collect()[0]
    assert row["rho"] == pytest.approx(-0.833333, abs=1e-6)


def test_spearman_ranks_inside_the_complete_pairs(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 400) - 4.0, "b": rng.normal(size=400) * 1000})
    pdf["y"] = (pdf["a"] + rng.integers(0, 6, 400)).astype(int)
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "b"] = np.nan
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame([(a, b, int(y)) for a, b, y in rows], "a double, b double, y int")
    got = {r["feature"]: r["rho"] for r in st.spearman(df, ["a", "b"], "y").collect()}
    for c in ("a", "b"):
        pair = pdf[[c, "y"]].dropna().rank()
        assert got[c] == pytest.approx(pair[c].corr(pair["y"]), abs=1e-12)


def test_mann_whitney_by_counting_pairs(spark):
    first, second = [3, 5, 5, 9, 1], [1, 2, 5, 4]
    rows = [(v, 1) for v in first] + [(v, 2) for v in second] + [(None, 1), (7, 3)]
    df = spark.createDataFrame(rows, "v int, g int")
    row = st.mann_whitney_greater(df, "v", df.g == 1, df.g == 2).collect()[0]
    u = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    assert (row["n1"], row["n2"], row["u"]) == (5, 4, u)
    assert row["rank_biserial"] == pytest.approx(1 - 2 * u / 20)
    ties = sum(t**3 - t for t in pd.Series(first + second).value_counts())
    z = (u - 10 - 0.5) / math.sqrt(20 / 12 * (10 - ties / 72))
    assert row["z"] == pytest.approx(z)
    assert row["p_value"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))


def test_kruskal_wallis(spark):
    rows = [(v, g) for g, vs in enumerate([[1, 2, 2], [4, 5, 6], [2, 8, 9, 9]]) for v in vs]
    row = st.kruskal_wallis(spark.createDataFrame(rows, "v int, g int"), "v", "g").collect()[0]
    pdf = pd.DataFrame(rows, columns=["v", "g"])
    pdf["r"] = pdf["v"].rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * (pdf.groupby("g")["r"].sum() ** 2 / pdf.groupby("g").size()).sum()
    t = pdf["v"].value_counts()
    h = (h - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    assert row["groups"] == 3 and row["h"] == pytest.approx(h)
    assert row["p_value"] == pytest.approx(math.exp(-h / 2))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(p)], "name string, p double")
    got = {r["name"]: r for r in st.benjamini_hochberg(df, "p", "name").collect()}
    want = [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5]
    assert [got[f"t{i}"]["p_adjusted"] for i in range(4)] == pytest.approx(want)
    assert [got[f"t{i}"]["significant"] for i in range(4)] == [True, False, False, False]


def test_benjamini_hochberg_leaves_out_null_p(spark):
    rows = [("t0", 0.01), ("t1", None), ("t2", 0.04), ("t3", 0.03)]
    df = spark.createDataFrame(rows, "name string, p double")
    got = {r["name"]: r for r in st.benjamini_hochberg(df, "p", "name").collect()}
    assert got["t1"]["p_adjusted"] is None and got["t1"]["significant"] is None
    assert [got[k]["p_adjusted"] for k in ("t0", "t3", "t2")] == pytest.approx([0.03, 0.04, 0.04])
