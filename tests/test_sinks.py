"""Atomic replacement and ordered writes."""

import glob

import pytest
from pyspark.sql import functions as F

from orderlens.scratch import scratch_path
from orderlens.sources import sinks


def left_over(folder):
    return glob.glob(f"{folder}/_*")


@pytest.fixture
def stored(spark):
    folder = scratch_path(spark, "tables")
    sinks.replace_table(spark.range(10), f"{folder}/t")
    return folder


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def broken(spark):
    """Rows of which one raises an error after others have been written."""
    bad = F.when(F.col("id") == 90, F.raise_error(F.lit("bad row"))).otherwise(F.lit("x"))
    return spark.range(0, 100, 1, 5).withColumn("v", bad)


def test_a_table_is_replaced(spark, stored):
    sinks.replace_table(spark.range(3), f"{stored}/t/")
    assert ids(spark, f"{stored}/t") == [0, 1, 2] and left_over(stored) == []


def test_a_failed_write_leaves_the_old_table(spark, stored):
    with pytest.raises(Exception, match="bad row"):
        sinks.replace_table(broken(spark), f"{stored}/t")
    assert ids(spark, f"{stored}/t") == list(range(10)) and left_over(stored) == []


def test_a_failed_first_write_leaves_nothing(spark, stored):
    with pytest.raises(Exception, match="bad row"):
        sinks.write_csv(broken(spark), f"{stored}/new")
    assert glob.glob(f"{stored}/new") == [] and left_over(stored) == []


def test_a_table_may_be_replaced_by_what_reads_it(spark, stored):
    path = f"{stored}/t"
    sinks.replace_table(spark.read.parquet(path).filter("id > 4"), path)
    assert ids(spark, path) == [5, 6, 7, 8, 9]


def test_a_failed_swap_puts_the_old_table_back(spark, stored, monkeypatch):
    files, make = sinks._files(spark, stored)

    class Refuses:
        """The file system, but a rename of the new folder fails."""

        def __getattr__(self, name):
            return getattr(files, name)

        def rename(self, a, b):
            return False if "/_new-" in a.toString() else files.rename(a, b)

    monkeypatch.setattr(sinks, "_files", lambda spark, path: (Refuses(), make))
    with pytest.raises(OSError, match="could not be replaced"):
        sinks.replace_table(spark.range(3), f"{stored}/t")
    assert ids(spark, f"{stored}/t") == list(range(10)) and left_over(stored) == []


def test_partitioned_tables(spark, stored):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    sinks.replace_table(df, f"{stored}/t", "g")
    assert spark.read.parquet(f"{stored}/t").filter("g = 1").count() == 5


def test_ordered_files_follow_each_other(spark, stored):
    df = spark.range(0, 5000, 1, 7).withColumn("k", (F.col("id") * 7919) % 5003)
    path = f"{stored}/o"
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("6", "false")):
            spark.conf.set(n, v)
        sinks.write_ordered(df, path, [F.col("k").desc(), F.col("id")])
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
    files = sorted(glob.glob(f"{path}/part-*"))
    got = [(r["k"], r["position"]) for f in files for r in spark.read.parquet(f).collect()]
    assert len(files) > 3
    assert got == [(k, i) for i, k in enumerate(sorted((r["k"] for r in df.collect()), reverse=True), 1)]
