"""Exact samples against a plain sort: ties, hot places, null groups, sizes around the border."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlens.operators import samples

ROW = "k long, g string, p long"


def wanted(rows, n):
    """Rows of each group with the n smallest (place, key)."""
    place = lambda r: (samples.MODULUS if r[2] is None else r[2], r[0])
    return sorted((r for g in {r[1] for r in rows} for r in sorted((x for x in rows if x[1] == g), key=place)[:n]), key=str)


@pytest.fixture(scope="module")
def rows():
    hot = [(k, "hot", (k * 7919) % 2147483647) for k in range(3000)]
    tied = [(k, "tied", 5) for k in range(5000, 5400)]
    near = [(k, "near", 1 << 20 | k % 40) for k in range(7000, 7300)]
    odd = [(9000, None, 3), (9001, None, 2147483646), (9002, None, 0), (9003, "one", None), (9004, "one", 2147483646)]
    return hot + tied + near + odd


@pytest.mark.parametrize("n", [0, 1, 2, 37, 299, 300, 400, 2999, 3000, 10_000])
def test_group_samples(spark, rows, n):
    df = spark.createDataFrame(rows, ROW).repartition(6)
    got = samples.sample_per_group(df, n, "g", "k", F.col("p"))
    assert sorted(map(tuple, got.collect()), key=str) == wanted(rows, n)
    assert got.columns == df.columns


@pytest.mark.parametrize("n", [0, 1, 399, 401, 500, 3500, 10_000])
def test_whole_samples(spark, rows, n):
    df = spark.createDataFrame(rows, ROW).repartition(6)
    got = samples.sample_exact(df, n, "k", F.col("p")).collect()
    one_group = wanted([(k, "", p) for k, _, p in rows], n)
    assert sorted(r["k"] for r in got) == sorted(r[0] for r in one_group)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from(["a", "b", None]), st.sampled_from([0, 1, 1023, 1024, 1 << 20, (1 << 31) - 2])), max_size=40, unique_by=lambda r: r[0]), st.integers(1, 12))
def test_places_at_bucket_borders(spark, rows, n):
    got = samples.sample_per_group(spark.createDataFrame(rows, ROW), n, "g", "k", F.col("p")).collect()
    assert sorted(map(tuple, got), key=str) == wanted(rows, n)


def test_default_places_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 7)
    first = {r["id"] for r in samples.sample_per_group(df, 30, "g", "id").collect()}
    again = {r["id"] for r in samples.sample_per_group(df.repartition(9), 30, "g", "id").collect()}
    assert len(first) == 210 and first == again
