"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from orderlens.operators import histograms, samples, summaries
from orderlens.plans import drivers, evaluation, exploration, master
from orderlens.scratch import scratch_path
from orderlens.sources import sinks
from orderlens.sources.tables import read_parquet_tables


def plan(df, run=False):
    """Physical plan; after a run, the final adaptive one."""
    query = df._jdf.queryExecution()
    if run:
        df.collect()
    return query.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module", autouse=True)
def full_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def stored(spark, tables):
    folder = scratch_path(spark, "stored")
    for name, df in tables.items():
        sinks.replace_table(df, f"{folder}/{name}")
    return read_parquet_tables(spark, folder)


def test_filters_and_columns_reach_the_scans(stored):
    text = plan(master.master_notebook(stored))
    assert "EqualTo(order_status,delivered)" in text
    assert "IsNotNull(order_delivered_customer_date)" in text
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    items = next(s for s in schemas if "order_item_id" in s)
    assert "shipping_limit_date" not in items
    reviews = next(s for s in schemas if "review_id" in s)
    assert "review_comment" not in reviews


def test_no_nested_loops_and_no_python(stored):
    reviewed = master.reviewed(master.master_notebook(stored))
    for df in (
        drivers.spearman_scores(reviewed),
        drivers.delay_histogram(reviewed),
        drivers.pearson_heatmap(reviewed),
        exploration.monthly_orders(stored["orders"]),
        master.cleaning_funnel(stored),
    ):
        found = re.findall(r"CartesianProduct|NestedLoop|EvalPython|InPandas|InArrow", plan(df))
        assert found == []


def test_rank_tests_read_the_rows_once(stored):
    """Ranks and sums come from written value counts, not from the order tables."""
    reviewed = master.reviewed(master.master_notebook(stored))
    text = plan(drivers.spearman_scores(reviewed), run=True)
    scanned = re.findall(r"Location: \w+[^\[]*\[[^\]]*/([\w-]+)-[0-9a-f]{32}\]", text)
    assert set(scanned) == {"value-pairs", "value-counts"}
    assert len(scanned) == len(re.findall("FileScan", text))


def test_narrow_values_are_spread(spark):
    """A million distinct values between 1000 and 1001: no stretch holds more than a few percent."""
    df = spark.range(1_000_000).select((1000 + F.col("id") / 1e6).alias("v"), F.lit(1).alias("n"))
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    old = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, ("64", "false")):
            spark.conf.set(name, value)
        counts = histograms.sorted_counts(df, [], "v")
        sizes = [r["count"] for r in counts.groupBy("_part").count().collect()]
        row = histograms.quantiles(counts, [], "v", [0.25, 0.5]).collect()[0]
    finally:
        for name, value in zip(names, old):
            spark.conf.set(name, value)
    assert len(sizes) > 50 and max(sizes) < 40_000 and sum(sizes) == 1_000_000
    assert (row["q0"], row["q1"]) == pytest.approx((1000.24999975, 1000.4999995), abs=1e-9)


def test_samples_are_cut_by_a_comparison(spark):
    """No sort, window or limit over the rows: each is compared with the cut of its group."""
    df = spark.range(10_000).withColumn("g", F.col("id") % 3)
    for sampled in (samples.sample_per_group(df, 500, "g", "id"), samples.sample_exact(df, 500, "id")):
        text = plan(sampled, run=True)
        assert "Join" in text and not re.search(r"Window|TakeOrdered|Limit|Sort ", text)


def test_top_k_needs_no_full_sort(spark):
    df = spark.range(100)
    assert "TakeOrderedAndProject" in plan(summaries.top(df, 3, F.col("id").desc()))


def test_order_id_joins_share_one_partitioning(spark, stored):
    """Items and reviews are grouped by order_id and joined without another shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(master.master_notebook(stored))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", text)) == 3


def test_a_hot_customer_is_split(spark):
    """One customer with a third of the reviewed orders: the join deals it to several tasks."""
    n = 60_000
    customer = F.when(F.col("id") % 3 == 0, "c0").otherwise(F.concat(F.lit("c"), F.col("id") % 5000))
    reviewed = spark.range(n).select(
        F.xxhash64("id").alias("order_id"),
        customer.alias("customer_unique_id"),
        (F.col("id") % 2).alias("is_negative_review"),
        (F.col("id") % 5 + 1).alias("review_score"),
        F.xxhash64("id", F.lit(1)).alias("delivery_delay_days"),
    )
    segment = F.when(F.col("id") == 0, "Loyal").otherwise("Lost")
    customers = spark.range(5000).select(
        F.concat(F.lit("c"), "id").alias("customer_unique_id"), segment.alias("segment")
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    }
    old = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = evaluation.satisfaction_by_segment(reviewed.repartition(12), customers)
        text = plan(found, run=True)
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert re.search(r"SortMergeJoin\(skew=true\)", text)
    sizes = {r["segment"]: r["n_orders"] for r in found.collect()}
    assert sizes == {"Loyal": n // 3 + sum(i % 5000 == 0 for i in range(n) if i % 3), "Lost": n - sizes["Loyal"]}
