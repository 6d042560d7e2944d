"""Sources, sinks, quality reports, samples and whole-job invariants."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from orderlens.operators import quality, samples, summaries
from orderlens.plans import evaluation, master, retention, rfm
from orderlens.scratch import materialize, scratch_path, scratch_scope
from orderlens.sources import sinks
from orderlens.sources.tables import RESCUE, ingest, load_tables, read_parquet_tables, run_script


def test_csv_load_skips_missing_and_coerces(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_status,order_id,extra,order_purchase_timestamp\n"
        "delivered,a1,x,2017-10-02 10:56:33\n"
        "shipped,a2,y,not a date\n"
    )
    (tmp_path / "order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_message\n"
        'r1,a1,5,"good, ""very""\nsecond line"\n'
        "r2,a2,x,\n"
    )
    tables, report = load_tables(spark, str(tmp_path))
    assert set(tables) == {"orders", "order_reviews"}
    status = {r["table"]: (r["status"], r["rows"]) for r in report.collect()}
    assert status["orders"] == ("loaded", 2) and status["order_reviews"] == ("loaded", 2)
    assert status["sellers"] == ("skipped", None) and len(status) == 9
    orders = {r["order_id"]: r for r in tables["orders"].collect()}
    assert orders["a1"]["order_purchase_timestamp"] == dt.datetime(2017, 10, 2, 10, 56, 33)
    assert orders["a2"]["order_purchase_timestamp"] is None and orders["a1"]["extra"] == "x"
    reviews = {r["review_id"]: r for r in tables["order_reviews"].collect()}
    assert reviews["r1"]["review_comment_message"] == 'good, "very"\nsecond line'
    assert reviews["r2"]["review_score"] is None


def test_ingest_replaces_and_reports(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text("seller_id,seller_state\ns1,SP\ns2,RJ\n")
    target = scratch_path(spark, "ingest")
    for _ in range(2):
        report = {r["table"]: r["rows"] for r in ingest(spark, str(tmp_path), target).collect()}
    assert report["sellers"] == 2 and report["orders"] is None and len(report) == 9
    assert read_parquet_tables(spark, target, ["sellers"])["sellers"].count() == 2


def test_rejected_values_stay_with_their_line(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,order_purchase_timestamp,extra,order_approved_at\n"
        "a1,2017-10-02 10:56:33,x,2017-02-30 00:00:00\n"
        "a2,not a date,y,\n"
        "a3,25:61,,never\n"
        "a4,,,2018-01-01 00:00:00\n"
    )
    (tmp_path / "sellers.csv").write_text("seller_id,seller_state\ns1,SP\n")
    target = scratch_path(spark, "rescue")
    report = {r["table"]: r for r in ingest(spark, str(tmp_path), target, rescue=True).collect()}
    assert report["orders"]["rejected"] == {"order_purchase_timestamp": 2, "order_approved_at": 2}
    assert report["sellers"]["rejected"] == {} and report["customers"]["rejected"] is None
    rows = {r["order_id"]: r for r in spark.read.parquet(f"{target}/orders").collect()}
    assert rows["a1"][RESCUE] == {"order_approved_at": "2017-02-30 00:00:00"}
    assert rows["a2"][RESCUE] == {"order_purchase_timestamp": "not a date"} and rows["a2"]["extra"] == "y"
    assert rows["a3"][RESCUE] == {"order_purchase_timestamp": "25:61", "order_approved_at": "never"}
    assert rows["a4"][RESCUE] is None and rows["a4"]["order_purchase_timestamp"] is None


def test_export_receipt_and_reload(spark):
    folder = scratch_path(spark, "sink")
    df = spark.range(7).withColumn("v", F.col("id") * 2)
    for fmt in ("csv", "parquet"):
        receipt = sinks.export(df, "t", f"{folder}/{fmt}", fmt, order=["id"]).collect()
        assert [tuple(r) for r in receipt] == [("t", 7, 2)]
        sinks.export(df.limit(3), "t", f"{folder}/{fmt}", fmt)  # replaces
    assert spark.read.parquet(f"{folder}/parquet").count() == 3
    sinks.replace_table(df, f"{folder}/orders", partition_by="v")
    back = read_parquet_tables(spark, folder, ["orders"])["orders"]
    assert back.count() == 7


def test_sql_text_over_bound_tables(spark):
    df = spark.range(5)
    assert run_script(spark, "SELECT sum(id) AS s FROM {t}", {"t": df}).collect()[0]["s"] == 10


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")
    assert tuple(quality.duplicate_rows(df).collect()[0]) == (3, 1)


def test_profile_exact_and_approximate(spark):
    df = spark.createDataFrame([(1, None, -0.0), (1, "x", 0.0), (2, "x", 1.5)], "a int, b string, c double")
    exact = {r["column"]: r for r in quality.column_profile(df).collect()}
    assert exact["b"]["nulls"] == 1 and exact["b"]["null_pct"] == 33.33
    assert [exact[c]["distinct_values"] for c in "abc"] == [2, 1, 2]
    assert exact["a"]["dtype"] == "int"
    rough = {r["column"]: r for r in quality.column_profile(df, approximate=True).collect()}
    assert {c: rough[c]["nulls"] for c in "abc"} == {"a": 0, "b": 1, "c": 0}


def test_profile_counts_whole_numbers_by_words(spark):
    rows = [(v, v % 3 == 0 if v % 5 else None, dt.date(1969, 12, 1) + dt.timedelta(v % 90)) for v in range(-200, 200)]
    ends = [(-(2**63), None, None), (2**63 - 1, None, None), (None, None, None)]
    df = spark.createDataFrame(rows * 2 + ends, "a bigint, b boolean, c date").withColumn("d", F.expr("tinyint(a % 7)"))
    df = df.withColumn("t", F.col("c").cast("timestamp_ntz")).withColumn("e", F.lit(None).cast("int"))
    got = {r["column"]: r for r in quality.column_profile(df).collect()}
    for c in df.columns:
        assert got[c]["distinct_values"] == df.select(c).dropna().distinct().count(), c
        assert got[c]["nulls"] == df.filter(F.col(c).isNull()).count(), c


def test_samples_are_exact_and_fixed(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    first = {r["id"] for r in samples.sample_exact(df, 50, "id").collect()}
    again = {r["id"] for r in samples.sample_exact(df.repartition(7), 50, "id").collect()}
    assert len(first) == 50 and first == again
    sizes = samples.sample_per_group(df, 200, "g", "id").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in sizes} == {"hot": 200, "cold": 100}


def test_integrity_holds_and_is_enforced(spark, tables):
    table = master.master_notebook(tables)
    master.assert_integrity(table)
    with pytest.raises(AssertionError, match="delivery_days"):
        master.assert_integrity(table.withColumn("delivery_days", F.lit(0)))


def test_two_forms_of_the_master_differ_only_where_they_should(spark, tables):
    a = master.master_sql(tables).alias("a")
    b = master.master_notebook(tables).alias("b")
    only_sql = a.join(b, "order_id", "left_anti")
    assert b.join(a, "order_id", "left_anti").count() == 0
    assert only_sql.filter("delivery_days >= 1").count() == 0
    both = a.join(b, "order_id")
    same = ["customer_unique_id", "price_total", "freight_total", "n_items", "review_score"]
    same += ["is_negative_review", "order_month", "review_creation_date"]
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    differs = differs | (F.floor("a.delivery_days") != F.col("b.delivery_days"))
    differs = differs | (F.col("a.order_weekday").cast("int") != (F.col("b.order_weekday") + 1) % 7)
    assert both.filter(differs).count() == 0


def test_segments_cover_all_customers(spark, tables):
    table = rfm.rfm_table(master.master_notebook(tables))
    n = table.count()
    assert rfm.segment_summary(table).agg(F.sum("n_customers")).collect()[0][0] == n
    assert table.select("customer_unique_id").distinct().count() == n
    assert [r["segment"] for r in rfm.in_segment_order(rfm.segment_scores(table)).collect()][0] == "Champions"


def test_quality_of_notebook_summary_order(spark, tables):
    table = master.master_notebook(tables)
    ranked = retention.retention_ranking(tables, min_customers=3)
    summary = evaluation.executive_summary(
        master.reviewed(table), rfm.rfm_table(table), retention.retention_with_ci(ranked)
    )
    panels = [r["panel"] for r in evaluation.summary_order(summary).collect()]
    assert panels == sorted(panels) and set(panels) == set("ABCD") and panels.count("C") == 6


def test_scratch_is_released_at_the_end_of_a_scope(spark):
    outer = materialize(spark.range(3), "outer")
    with scratch_scope(spark):
        inner = scratch_path(spark, "inner")
        spark.range(5).write.parquet(inner)
        assert spark.read.parquet(inner).count() == 5
    assert not os.path.exists(inner) and outer.count() == 3


def test_script_and_frame_agree(spark, tables):
    a = retention.retention_ranking(tables, 3)
    b = retention.retention_script(tables, 3)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 5


def test_first_orders_agree_with_the_full_sequence(spark, tables):
    sequence = retention.order_sequence(tables).filter("purchase_rank = 1")
    history = retention.customer_history(tables)
    cols = ["customer_unique_id", "order_id", "total_orders"]
    assert sequence.select(cols).exceptAll(history.select(cols)).count() == 0
    assert sequence.count() == history.count()
