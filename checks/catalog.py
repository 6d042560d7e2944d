"""Every job as a query over a folder of generated tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.scalars import half_even
from orderlens.operators import histograms, quality, samples, summaries
from orderlens.operators.positions import number_rows
from orderlens.operators.statistics import correlations_of, pearson_pairs
from orderlens.plans import drivers, evaluation, exploration, master, retention, rfm
from orderlens.scratch import materialize, scratch_path
from orderlens.sources import sinks
from orderlens.sources.fixture import fixture_tables
from orderlens.sources.tables import RESCUE, ingest, load_tables

SEED = 42
# labels that the queries attach to drivers, places and segments
NOTES = {"delivery_days": "time", "delivery_delay_days": "delay", "n_items": "size"}
READINGS = {1: "first", 2: "second", 3: "third"}
STEPS = {1: "step one", 2: "step two", 3: "step three"}
ACTIONS = {name: f"action {i}" for i, name in enumerate(rfm.SEGMENTS, 1)}
PROFILES = {"Champions": "A", "Loyal": "B", "New Customers": "C", "At Risk": "D", "Lost": "E"}


def fixed(df, places=8):
    """Doubles to a fixed number of decimals, so that two engines can be compared."""
    own = lambda name: 5 if name.startswith("neg_log10") else places
    return df.select(
        *[
            (half_even(F.col(f.name), own(f.name)) + 0.0).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _by_key(key):
    return samples.scattered(F.col(key), SEED)


def _reviewed(t):
    return master.reviewed(master.master_notebook(t))


def _rfm(t):
    return rfm.rfm_table(master.master_notebook(t))


def _written_master(t):
    """The master table written once, for jobs that read it more than once."""
    return materialize(master.master_notebook(t), "master")


def _with_ci(t):
    return retention.retention_with_ci(retention.retention_ranking(t))


# --- loading, writing, quality -------------------------------------------------------------


def load_report(t):
    """All tables written as CSV and ingested to Parquet; one file is left out on purpose."""
    spark = t["orders"].sparkSession
    folder = scratch_path(spark, "csv")
    files = {}
    for name, df in t.items():
        files[name] = f"{name}.csv"
        if name != "sellers":
            sinks.write_csv(df, f"{folder}/{files[name]}")
    schemas = {name: df.schema for name, df in t.items()}
    return ingest(spark, folder, scratch_path(spark, "tables"), files, schemas)


def csv_round_trip(t):
    """Orders written as CSV and loaded back with their types."""
    spark = t["orders"].sparkSession
    folder = scratch_path(spark, "csv")
    sinks.write_csv(t["orders"], f"{folder}/orders.csv")
    files = {"orders": "orders.csv"}
    return load_tables(spark, folder, files, {"orders": t["orders"].schema})[0]["orders"]


def bad_orders(t):
    """A folder with orders.csv, in which some timestamps are no timestamps, and its schema."""
    spark = t["orders"].sparkSession
    folder = scratch_path(spark, "bad-csv")
    key = F.col("order_id")
    bought = F.when(key % 7 == 0, "not a date").when(key % 11 == 0, "2017-13-45 10:00:00")
    arrived = F.when(key % 5 == 0, "31/12/2017")
    text = lambda c: F.col(c).cast("string")
    changed = t["orders"].withColumns(
        {
            "order_purchase_timestamp": bought.otherwise(text("order_purchase_timestamp")),
            "order_delivered_customer_date": arrived.otherwise(text("order_delivered_customer_date")),
        }
    )
    sinks.write_csv(changed, f"{folder}/orders.csv")
    return folder, {"orders": t["orders"].schema}


def csv_rejects(t):
    """Ingest report of that folder: rejected values per column."""
    folder, schemas = bad_orders(t)
    spark = t["orders"].sparkSession
    report = ingest(spark, folder, scratch_path(spark, "tables"), schemas=schemas, rescue=True)
    return report.select("table", "rows", F.explode("rejected").alias("column", "rejected"))


def csv_rescued(t):
    """Rejected values of the stored table, with the order they belong to."""
    folder, schemas = bad_orders(t)
    spark = t["orders"].sparkSession
    target = scratch_path(spark, "tables")
    ingest(spark, folder, target, schemas=schemas, rescue=True)
    stored = spark.read.parquet(f"{target}/orders")
    return stored.select("order_id", F.explode(RESCUE).alias("column", "value"))


def export_receipt(t):
    """Master, customer and segment tables exported, with the rows counted during the write."""
    spark = t["orders"].sparkSession
    folder = scratch_path(spark, "export")
    table = _written_master(t)
    scored = rfm.rfm_table(table)
    written = [
        sinks.export(table, "master_csv", f"{folder}/master_csv", "csv"),
        sinks.export(table, "master", f"{folder}/master"),
        sinks.export(scored, "rfm", f"{folder}/rfm", "csv"),
        sinks.export(rfm.segment_summary(scored), "rfm_segments", f"{folder}/segments", "csv"),
    ]
    return summaries.stack(*written)


def ordered(df, *keys):
    """The frame written in a total order and read back with the position of each row."""
    path = scratch_path(df.sparkSession, "ordered")
    sinks.write_ordered(df, path, keys)
    return df.sparkSession.read.parquet(path)


def master_ordered(t):
    columns = ["order_id", "order_purchase_timestamp", "customer_unique_id", "price_total"]
    keys = [F.col("order_purchase_timestamp"), F.col("order_id")]
    return ordered(master.master_sql(t).select(*columns), *keys)


def retention_ordered(t):
    ranking = retention.retention_ranking(t)
    return ordered(ranking, F.col("retention_rank"), F.col("category"))


def by_segment(df, *more):
    return ordered(df, summaries.label_order(F.col("segment"), rfm.SEGMENTS), F.col("segment"), *more)


def executive_summary_ordered(t):
    place = summaries.label_order(F.col("label"), rfm.SEGMENTS)
    keys = [F.col("panel"), place, F.col("value").desc(), F.col("label")]
    return ordered(fixed(executive_summary(t)), *keys)


def residual_nulls(t):
    return quality.residual_nulls(master.master_notebook(t))


def first_months(t):
    months = master.master_notebook(t).select("order_month").distinct()
    return months.orderBy("order_month").limit(8)


def unknown_categories(t):
    named = master.product_category(t["products"], t["category_translation"])
    return named.agg(
        F.count_if(F.col("category_en") == "unknown").alias("untranslated_products"),
        F.count_distinct("category_en").alias("categories"),
    )


# --- customers -----------------------------------------------------------------------------


def spend_rank(t):
    """Whole-table rank of customers by spend, the lower id first on ties."""
    metrics = rfm.rfm_metrics(master.master_notebook(t))
    keys = [F.col("monetary").asc(), F.col("customer_unique_id").asc()]
    ranked = number_rows(metrics, keys, "spend_rank", "n_customers")
    return ranked.select("customer_unique_id", "monetary", "spend_rank", "n_customers")


def rfm_first_rows(t):
    return summaries.top(_rfm(t), 5, F.col("customer_unique_id").asc())


def base_summary(t):
    table = master.master_notebook(t)
    return table.agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_distinct("customer_unique_id").alias("n_customers"),
        F.min("order_purchase_timestamp").cast("date").alias("first_order"),
        F.max("order_purchase_timestamp").cast("date").alias("last_order"),
        (F.max("order_purchase_timestamp") + F.expr("interval 1 day"))
        .cast("date")
        .alias("snapshot"),
    )


def frequency_score_share(t):
    """Customers per frequency score with their share."""
    return fixed(summaries.frequency(_rfm(t), "F_score"))


def executive_summary(t):
    table = _written_master(t)
    return evaluation.executive_summary(
        master.reviewed(table), rfm.rfm_table(table), _with_ci(t)
    )


def satisfaction(t):
    table = _written_master(t)
    return evaluation.satisfaction_by_segment(master.reviewed(table), rfm.rfm_table(table))


def input_overview(t):
    table = _written_master(t)
    frames = {
        "master": table,
        "master_reviewed": master.reviewed(table),
        "rfm": rfm.rfm_table(table),
        "retention": retention.retention_ranking(t),
    }
    return evaluation.overview(frames)


def payment_box(t):
    totals = exploration.payment_totals(t["order_payments"])
    return histograms.box_stats(histograms.tally(totals, [], "payment_value"), [], "payment_value")


def payment_outliers(t):
    totals = exploration.payment_totals(t["order_payments"])
    return histograms.outliers(totals, "payment_value", payment_box(t))


def payment_describe(t):
    totals = exploration.payment_totals(t["order_payments"])
    return summaries.describe(totals, ["payment_value"], (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


def _box(df, group, value):
    return histograms.box_stats(histograms.tally(df, [group], value), [group], value)


def box_by(value):
    return lambda t: fixed(_box(_reviewed(t), "review_score", value))


def eda_correlations(t):
    pairs = pearson_pairs(exploration.order_frame(t), exploration.ANALYSIS_COLUMNS)
    return fixed(correlations_of(pairs, "review_score"))


def delay_days_correlation(t):
    pairs = pearson_pairs(_reviewed(t), ["delivery_delay_days", "delivery_days"])
    return fixed(pairs)


def numeric_columns(t):
    """Numeric columns of the reviewed master table."""
    named = [
        F.struct(F.lit(f.name).alias("column"), F.count(f.name).alias("values"))
        for f in master.master_notebook(t).schema
        if isinstance(f.dataType, T.NumericType)
    ]
    return _reviewed(t).agg(F.array(*named).alias("c")).select(F.inline("c"))


def rfm_describe(t):
    stats = summaries.describe(
        rfm.rfm_metrics(master.master_notebook(t)), ["recency", "frequency", "monetary"]
    )
    return fixed(stats, 1)


def segment_box(value):
    return lambda t: fixed(_box(rfm.clipped_monetary(_rfm(t)), "segment", value), 6)


QUERIES = {
    # loading, writing, quality
    "load_report": load_report,
    "csv_round_trip": csv_round_trip,
    "csv_rejects": csv_rejects,
    "csv_rescued": csv_rescued,
    "export_receipt": export_receipt,
    "table_shapes": lambda t: quality.per_table(t, quality.shape),
    "quality_all_tables": lambda t: quality.per_table(t, quality.column_profile),
    "duplicates_all_tables": lambda t: quality.per_table(t, quality.duplicate_rows),
    "residual_nulls": residual_nulls,
    "cleaning_funnel": lambda t: fixed(master.cleaning_funnel(t)),
    "review_dedup": master.review_dedup_counts,
    "integrity_checks": lambda t: master.integrity_checks(master.master_notebook(t)),
    "leakage_audit": lambda t: fixed(master.leakage_audit(t)),
    "unknown_categories": unknown_categories,
    # building blocks and master table
    "items_per_order": lambda t: master.items_per_order(t["order_items"], "min"),
    "items_per_order_first": lambda t: master.items_per_order(t["order_items"], "first"),
    "latest_review": lambda t: master.latest_review(t["order_reviews"]),
    "main_item": lambda t: master.dearest_item(t["order_items"]),
    "product_category": lambda t: master.product_category(
        t["products"], t["category_translation"]
    ),
    "master_sql": master.master_sql,
    "master_notebook": master.master_notebook,
    "master_sql_ordered": master_ordered,
    "negative_flag_counts": lambda t: fixed(
        master.negative_flag_counts(master.master_notebook(t))
    ),
    "first_months": first_months,
    "numeric_columns": numeric_columns,
    "feature_summary": lambda t: drivers.feature_summary(master.master_notebook(t)),
    # exploration
    "score_distribution": lambda t: exploration.score_distribution(t["order_reviews"]),
    "score_summary": lambda t: exploration.score_summary(t["order_reviews"]),
    "status_distribution": lambda t: exploration.status_distribution(t["orders"]),
    "status_lookup": lambda t: exploration.status_lookup(t["orders"]),
    "payment_describe": lambda t: fixed(payment_describe(t), 4),
    "payment_histogram": lambda t: fixed(exploration.payment_histogram(t["order_payments"]), 4),
    "payment_box": lambda t: fixed(payment_box(t), 4),
    "payment_outliers": payment_outliers,
    "eda_order_frame": lambda t: fixed(exploration.order_frame(t)),
    "eda_pearson": lambda t: fixed(
        pearson_pairs(exploration.order_frame(t), exploration.ANALYSIS_COLUMNS)
    ),
    "eda_score_correlations": eda_correlations,
    "top_categories": exploration.top_categories,
    "date_range": lambda t: exploration.date_range(t["orders"]),
    "monthly_orders": lambda t: exploration.monthly_orders(t["orders"]),
    "peak_months": lambda t: exploration.peak_months(exploration.monthly_orders(t["orders"])),
    # negative-review drivers
    "negative_total": lambda t: fixed(drivers.negative_total(_reviewed(t))),
    "driver_pearson": lambda t: fixed(drivers.pearson_heatmap(_reviewed(t))),
    "delay_days_correlation": delay_days_correlation,
    "spearman_scores": lambda t: fixed(drivers.spearman_scores(_reviewed(t))),
    "leakage_spearman": lambda t: fixed(drivers.leakage_spearman(_reviewed(t)), 6),
    "delay_mann_whitney": lambda t: fixed(drivers.delay_mann_whitney(_reviewed(t)), 6),
    "delivery_kruskal": lambda t: fixed(drivers.delivery_kruskal(_reviewed(t)), 5),
    "driver_table": lambda t: fixed(drivers.driver_table(_reviewed(t))),
    "driver_ranking": lambda t: fixed(
        drivers.driver_ranking(drivers.driver_table(_reviewed(t)), NOTES)
    ),
    "driver_actions": lambda t: fixed(
        drivers.driver_actions(drivers.driver_table(_reviewed(t)), READINGS, STEPS)
    ),
    "driver_effects": lambda t: fixed(drivers.driver_effects(_reviewed(t))),
    "delay_ci_by_score": lambda t: fixed(drivers.delay_ci_by_score(_reviewed(t))),
    "medians_by_score": lambda t: fixed(drivers.medians_by_score(_reviewed(t)), 6),
    "mean_days_by_score": lambda t: drivers.mean_days_by_score(_reviewed(t)),
    "delay_box_by_score": box_by("delivery_delay_days"),
    "items_box_by_score": box_by("n_items"),
    "freight_box_by_score": box_by("freight_ratio"),
    "days_box_by_score": box_by("delivery_days"),
    "late_vs_ontime": lambda t: fixed(drivers.late_vs_ontime(_reviewed(t))),
    "category_negative_rates": lambda t: fixed(
        drivers.category_negative_rates(_reviewed(t), min_orders=120)
    ),
    "category_rate_extremes": lambda t: fixed(
        drivers.rate_extremes(drivers.category_negative_rates(_reviewed(t), min_orders=120))
    ),
    "state_negative_top10": lambda t: fixed(drivers.negative_by_state(_reviewed(t))),
    "median_delay_top8": lambda t: drivers.median_delay_of_top_categories(
        master.master_notebook(t)
    ),
    "delay_histogram": lambda t: fixed(drivers.delay_histogram(master.master_notebook(t)), 6),
    "delay_sample": lambda t: drivers.delay_sample(_reviewed(t), by=_by_key("order_id")),
    "delay_sample_500": lambda t: drivers.delay_sample(_reviewed(t), 500, _by_key("order_id")),
    # customers
    "base_summary": base_summary,
    "rfm_metrics": lambda t: rfm.rfm_metrics(master.master_notebook(t)),
    "rfm_describe": rfm_describe,
    "spend_rank": spend_rank,
    "rfm_table": _rfm,
    "rfm_first_rows": rfm_first_rows,
    "frequency_distribution": lambda t: histograms.tally(
        rfm.rfm_metrics(master.master_notebook(t)), [], "frequency"
    ),
    "frequency_score_share": frequency_score_share,
    "segment_counts": lambda t: fixed(summaries.frequency(_rfm(t), "segment")),
    "segment_summary": lambda t: rfm.segment_summary(_rfm(t)),
    "segment_summary_ordered": lambda t: by_segment(rfm.segment_summary(_rfm(t))),
    "segment_scores": lambda t: rfm.segment_scores(_rfm(t)),
    "m_by_f": lambda t: rfm.monetary_by_frequency_score(_rfm(t)),
    "stratified_sample": lambda t: fixed(
        rfm.stratified_sample(_rfm(t), by=_by_key("customer_unique_id")), 4
    ),
    "stratified_sample_100": lambda t: fixed(
        rfm.stratified_sample(_rfm(t), 100, _by_key("customer_unique_id")), 4
    ),
    "clipped_monetary": lambda t: fixed(rfm.clipped_monetary(_rfm(t)), 4),
    "recency_box_by_segment": segment_box("recency"),
    "spend_box_by_segment": segment_box("monetary_clipped"),
    "segment_actions": lambda t: rfm.segment_actions(_rfm(t), ACTIONS),
    # retention
    "order_sequence": retention.order_sequence,
    "returning_customers": retention.returning_customers,
    "first_orders_with_category": retention.first_orders_with_category,
    "retention_ranking": retention.retention_ranking,
    "retention_ranking_ordered": retention_ordered,
    "retention_script": retention.retention_script,
    "first_vs_repeat": retention.first_vs_repeat,
    "global_retention": retention.global_retention,
    "retention_rates": lambda t: fixed(
        retention.retention_rates(retention.retention_ranking(t), _rfm(t))
    ),
    "retention_wilson": lambda t: fixed(_with_ci(t)),
    "retention_robust_extremes": lambda t: fixed(retention.robust_extremes(_with_ci(t))),
    "retention_point_extremes": lambda t: fixed(retention.point_extremes(_with_ci(t))),
    # evaluation
    "input_overview": input_overview,
    "segment_profile": lambda t: fixed(
        evaluation.segment_profiles(rfm.segment_profile(_rfm(t)), PROFILES), 6
    ),
    "segment_checks": lambda t: evaluation.segment_checks(_rfm(t)),
    "satisfaction_by_segment": lambda t: fixed(satisfaction(t)),
    "satisfaction_ordered": lambda t: by_segment(fixed(satisfaction(t))),
    "executive_summary": lambda t: fixed(executive_summary(t)),
    "executive_summary_ordered": executive_summary_ordered,
}


def run(name, spark, folder):
    return QUERIES[name](fixture_tables(spark, folder))
