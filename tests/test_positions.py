"""Global and grouped row numbers, quintiles, quantiles and histograms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import histograms as h
from orderlens.operators.positions import number_rows, number_within, quintile_score


def test_first_come_rank_descending(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 5), (4, 1)], "id int, v int")
    rows = number_rows(df, [F.col("v").desc(), F.col("id")], "rank", "n").orderBy("id").collect()
    assert [r["rank"] for r in rows] == [1, 3, 2, 4]
    assert {r["n"] for r in rows} == {4}


def test_quintile_sizes_of_seven(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "id int, v double")
    rows = quintile_score(df, "v", "id").groupBy("score").count().orderBy("score").collect()
    assert [r["count"] for r in rows] == [2, 1, 1, 1, 2]


@pytest.mark.parametrize("n", [6, 23, 1500])
@pytest.mark.parametrize("ascending", [True, False])
def test_quintiles_equal_pandas(spark, n, ascending):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 40, n)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "id int, v int")
    got = quintile_score(df, "v", "id", ascending).orderBy("id").collect()
    rank = pd.Series(values).rank(method="first", ascending=ascending)
    want = pd.qcut(rank, q=5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert [r["score"] for r in got] == list(want)


@pytest.mark.parametrize("nulls", [0, 30, 900, 1100, 4000])
def test_group_larger_than_a_partition(spark, nulls):
    """One group holds most rows and crosses many sort partitions; one group is null."""
    rng = np.random.default_rng(1)
    keys = ["hot"] * 4000 + [f"k{i % 50}" for i in range(900)] + [None] * nulls
    pdf = pd.DataFrame({"g": keys, "t": rng.integers(0, 500, len(keys)), "id": range(len(keys))})
    df = spark.createDataFrame(
        [(g, int(t), i) for g, t, i in pdf.itertuples(index=False)], "g string, t int, id int"
    )
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep all eight sort partitions
        got = number_within(df, "g", [F.col("t"), F.col("id")], "rn", "n").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    pdf = pdf.sort_values(["t", "id"])
    pdf["rn"] = pdf.groupby("g", dropna=False).cumcount() + 1
    pdf["n"] = pdf.groupby("g", dropna=False)["id"].transform("size")
    both = pdf.merge(got, on="id")
    assert len(both) == len(pdf)
    assert (both["rn_x"] == both["rn_y"]).all() and (both["n_x"] == both["n_y"]).all()


def frame(spark, pdf):
    rows = [(str(g), None if pd.isna(v) else float(v)) for g, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.fixture(scope="module")
def mixed():
    """A hot group with a hot value, negative and tiny values, huge values and nulls."""
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(900, 12.5), rng.lognormal(4, 3, 600), -rng.lognormal(0, 2, 400)])
    small = np.concatenate([rng.uniform(0, 1e-3, 55), [1e12, np.nan, -1e12, 0.0]])
    return pd.DataFrame({"g": ["hot"] * len(hot) + ["s"] * len(small), "v": np.concatenate([hot, small])})


def test_quantiles_equal_numpy(spark, mixed):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = h.quantiles(h.tally(frame(spark, mixed), ["g"], "v"), ["g"], "v", probs).collect()
    for row in got:
        want = mixed[mixed.g == row["g"]]["v"].dropna().quantile(probs)
        assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want), rel=1e-12)
    assert len(got) == 2


def test_literal_percentiles(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (10,)], "v int")
    row = h.quantiles(h.tally(df, [], "v"), [], "v", [0.25, 0.5, 0.95]).collect()[0]
    assert [row["q0"], row["q1"], row["q2"]] == pytest.approx([1.75, 3.0, 9.1])


def test_average_ranks_equal_pandas(spark, mixed):
    got = h.average_ranks(h.tally(frame(spark, mixed), ["g"], "v"), ["g"], "v").toPandas()
    want = mixed.dropna().assign(r=mixed.groupby("g")["v"].rank()).drop_duplicates(["g", "v"])
    both = want.merge(got, on=["g", "v"])
    assert len(both) == len(want) == len(got)
    assert (both["r"] == both["avg_rank"]).all()


def test_box_stats(spark, mixed):
    got = h.box_stats(h.tally(frame(spark, mixed), ["g"], "v"), ["g"], "v").collect()
    for row in got:
        v = mixed[mixed.g == row["g"]]["v"].dropna()
        q1, q3 = v.quantile([0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert row["whisker_low"] == min(q1, inside.min())
        assert row["whisker_high"] == max(q3, inside.max())
        assert row["n_outliers"] == len(v) - len(inside) and row["n"] == len(v)


def test_whiskers_do_not_end_inside_the_box(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (100.0,)], "v double")
    row = h.box_stats(h.tally(df, [], "v"), [], "v").collect()[0]
    assert (row["q3"], row["whisker_high"], row["n_outliers"]) == (25.0, 25.0, 1)


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(5).integers(-50, 400, 3000)
    df = spark.createDataFrame([(int(v),) for v in values], "v int")
    got = h.equal_width_bins(h.tally(df, [], "v"), "v").orderBy("bin").collect()
    want, edges = np.histogram(values, bins=60)
    assert sum(r["n"] for r in got) == 3000
    assert [r["bin_start"] for r in got] == pytest.approx(list(edges[:-1]))
    assert [r["n"] for r in got] == list(want)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "v double")
    got = h.equal_width_bins(h.tally(df, [], "v"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 0, 4, 0]
    assert (got[0]["bin_start"], got[-1]["bin_end"]) == (4.5, 5.5)
