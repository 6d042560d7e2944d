"""Recency, frequency and monetary scores, customer segments and their summaries."""

from pyspark.sql import functions as F

from orderlens.functions.scalars import clip, days_floor, half_even, sum_money, to_cents
from orderlens.operators.histograms import quantile_scalar, quantiles, tally
from orderlens.operators.positions import quintile_score
from orderlens.operators.samples import sample_per_group
from orderlens.operators.summaries import label_order, lookup_frame
from orderlens.scratch import materialize

# fixed values: segment names in reporting order
SEGMENTS = ["Champions", "Loyal", "New Customers", "At Risk", "Lost", "Others"]


def rfm_metrics(master):
    """Recency in days, number of orders and spend per customer.

    The master table has one row per order, so a row count is the distinct order count.
    The customer rows are written once: the snapshot date and both score sorts read them,
    and the master table is computed a single time.
    """
    per_customer = master.groupBy("customer_unique_id").agg(
        F.max("order_purchase_timestamp").alias("last_purchase"),
        F.count("order_id").alias("frequency"),
        sum_money(F.col("price_total")).alias("monetary"),
    )
    stored = materialize(per_customer, "customers")
    # one day after the last purchase of all, time of day kept
    day = F.make_dt_interval(F.lit(1))
    snapshot = stored.agg(F.max("last_purchase") + day).scalar()
    recency = days_floor(F.col("last_purchase"), snapshot)
    return stored.withColumn("recency", recency).drop("last_purchase")


def frequency_score(frequency):
    """1 for a single order, 3 for two, 5 for more."""
    return F.when(frequency <= 1, 1).when(frequency == 2, 3).otherwise(5)


def segment(r, f):
    """Segment of a recency and a frequency score; the first rule that fits wins."""
    recent, old = r >= 4, r <= 2
    return (
        F.when(recent & (f >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal")
        .when(recent & (f == 1), "New Customers")
        .when(old & (f >= 3), "At Risk")
        .when(old & (f <= 2), "Lost")
        .otherwise("Others")
    )


def rfm_scores(metrics):
    """Add the three scores, their mean and their digits."""
    scored = quintile_score(metrics, "recency", "customer_unique_id", False, "R_score")
    scored = scored.withColumn("F_score", frequency_score(F.col("frequency")))
    scored = quintile_score(scored, "monetary", "customer_unique_id", True, "M_score")
    scores = [F.col(c) for c in ("R_score", "F_score", "M_score")]
    mean = (scores[0] + scores[1] + scores[2]) / F.lit(3.0)
    return scored.withColumn("RFM_score", half_even(mean, 2)).withColumn(
        "RFM_string", F.concat(*[c.cast("string") for c in scores])
    )


def rfm_table(master):
    """One row per customer with metrics, scores and segment."""
    scored = rfm_scores(rfm_metrics(master))
    return scored.withColumn("segment", segment(F.col("R_score"), F.col("F_score"))).select(
        "customer_unique_id",
        "frequency",
        "monetary",
        "recency",
        "R_score",
        "F_score",
        "M_score",
        "RFM_score",
        "RFM_string",
        "segment",
    )


def _segment_sums(rfm):
    return rfm.groupBy("segment").agg(
        F.count("customer_unique_id").alias("n_customers"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.sum(to_cents(F.col("monetary"))).alias("_cents"),
        F.avg("R_score").alias("avg_R"),
        F.avg("F_score").alias("avg_F"),
        F.avg("M_score").alias("avg_M"),
        F.avg("RFM_score").alias("avg_RFM_score"),
    )


def segment_profile(rfm):
    """Size, revenue share, means and medians per segment, unrounded."""
    sums = _segment_sums(rfm)
    totals = sums.agg(
        F.struct(F.sum("n_customers").alias("n"), F.sum("_cents").alias("cents"))
    ).scalar()
    med_r, med_m = [
        quantiles(tally(rfm, ["segment"], c), ["segment"], c, [0.5]) for c in ("recency", "monetary")
    ]
    cents = F.col("_cents")
    return (
        sums.withColumn("_t", totals)
        .join(med_r.withColumnRenamed("q0", "med_recency"), "segment")
        .join(med_m.withColumnRenamed("q0", "med_monetary"), "segment")
        .select(
            "segment",
            "n_customers",
            (F.col("n_customers") / F.col("_t.n") * 100).alias("pct_customers"),
            "avg_recency",
            "med_recency",
            "avg_frequency",
            (cents / F.col("n_customers") / 100.0).alias("avg_monetary"),
            "med_monetary",
            (cents / 100.0).alias("total_revenue"),
            (F.try_divide(cents, F.col("_t.cents")) * 100).alias("pct_revenue"),
            "avg_R",
            "avg_F",
            "avg_M",
            "avg_RFM_score",
        )
    )


def segment_summary(rfm):
    """The published summary: shares and means per segment, each rounded its own way."""
    sums = _segment_sums(rfm)
    totals = sums.agg(
        F.struct(F.sum("n_customers").alias("n"), F.sum("_cents").alias("cents"))
    ).scalar()
    cents, n = F.col("_cents"), F.col("n_customers")
    return sums.withColumn("_t", totals).select(
        "segment",
        "n_customers",
        half_even(n / F.col("_t.n") * 100, 1).alias("pct_customers"),
        half_even(F.col("avg_recency"), 0).alias("avg_recency_days"),
        half_even(F.col("avg_frequency"), 2).alias("avg_frequency"),
        half_even(cents / n / 100.0, 1).alias("avg_monetary"),
        half_even(cents / 100.0, 0).alias("total_revenue"),
        half_even(F.try_divide(cents, F.col("_t.cents")) * 100, 1).alias("pct_revenue"),
    )


def in_segment_order(df):
    return df.orderBy(label_order(F.col("segment"), SEGMENTS))


def segment_scores(rfm):
    """Mean score per segment, two decimals."""
    means = _segment_sums(rfm)
    return means.select(
        "segment",
        *[half_even(F.col(f"avg_{s}"), 2).alias(f"{s}_score") for s in ("R", "F", "M")],
    )


def monetary_by_frequency_score(rfm):
    """Mean, deviation and count of the monetary score per frequency score."""
    return rfm.groupBy("F_score").agg(
        half_even(F.avg("M_score"), 3).alias("mean"),
        half_even(F.stddev_samp("M_score"), 3).alias("std"),
        F.count("M_score").alias("count"),
    )


def stratified_sample(rfm, n=600, by=None):
    """Up to n customers per segment with spend clipped at the 95th percentile of all."""
    p95 = quantile_scalar(tally(rfm, [], "monetary"), "monetary", 0.95)
    rows = sample_per_group(rfm, n, "segment", "customer_unique_id", by)
    return rows.withColumn("monetary_clipped", clip(F.col("monetary"), high=p95))


def clipped_monetary(rfm):
    """Customers outside 'Others' with spend clipped at their own 95th percentile."""
    named = rfm.filter(F.col("segment") != "Others")
    p95 = quantile_scalar(tally(named, [], "monetary"), "monetary", 0.95)
    return named.withColumn("monetary_clipped", clip(F.col("monetary"), high=p95))


def segment_actions(rfm, actions):
    """Action and customer count of each segment of ``actions``, zero where a segment is empty."""
    counts = rfm.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    named = lookup_frame(rfm.sparkSession, actions, "segment", "action")
    return named.join(counts, "segment", "left").select(
        "segment", F.coalesce("n", F.lit(0)).alias("n_customers"), "action"
    )
