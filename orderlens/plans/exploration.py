"""Exploration: order-level analysis frame, distributions and the monthly series."""

from pyspark.sql import functions as F

from orderlens.functions.scalars import days_floor, half_even, seconds_between, sum_money, year_month
from orderlens.operators.histograms import equal_width_bins, quantile_scalar, tally
from orderlens.operators.summaries import frequency, top

# fixed values: columns of the correlation matrix
ANALYSIS_COLUMNS = [
    "review_score",
    "delivery_days",
    "delay_days",
    "payment_value",
    "payment_installments",
    "n_items",
    "price_total",
    "freight_total",
]


def order_frame(tables):
    """Orders with review mean, payment and item totals; reviewed and delivered ones only."""
    arrival = F.col("order_delivered_customer_date")
    orders = tables["orders"].select(
        "order_id",
        days_floor(F.col("order_purchase_timestamp"), arrival).alias("delivery_days"),
        days_floor(F.col("order_estimated_delivery_date"), arrival).alias("delay_days"),
    )
    reviews = tables["order_reviews"].groupBy("order_id").agg(
        F.avg("review_score").alias("review_score")
    )
    payments = tables["order_payments"].groupBy("order_id").agg(
        sum_money(F.col("payment_value")).alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
    )
    items = tables["order_items"].groupBy("order_id").agg(
        F.count("order_item_id").alias("n_items"),
        sum_money(F.col("price")).alias("price_total"),
        sum_money(F.col("freight_value")).alias("freight_total"),
    )
    return (
        orders.join(reviews, "order_id", "left")
        .join(payments, "order_id", "left")
        .join(items, "order_id", "left")
        .dropna(subset=["review_score", "delivery_days"])
    )


def score_distribution(reviews):
    """Reviews per score with the percentage to one decimal."""
    counts = frequency(reviews, "review_score")
    return counts.select("review_score", "n", half_even(F.col("pct"), 1).alias("pct"))


def score_summary(reviews):
    """Mean, median and the percentage of negative scores, summed from rounded percentages."""
    counts = tally(reviews, [], "review_score")
    n, score = F.col("n"), F.col("review_score")
    mean = half_even(F.try_divide(F.sum(score * n), F.sum(n)), 2)
    shares = score_distribution(reviews).filter("review_score <= 2")
    negative = half_even(F.coalesce(F.sum("pct"), F.lit(0.0)), 1)
    return counts.agg(mean.alias("mean_score")).select(
        "mean_score",
        quantile_scalar(counts, "review_score", 0.5).alias("median_score"),
        shares.agg(negative).scalar().alias("pct_negative"),
    )


def status_distribution(orders):
    """Orders per status with the percentage to two decimals."""
    counts = frequency(orders, "order_status", keep_null=True)
    return counts.select("order_status", "n", half_even(F.col("pct"), 2).alias("pct"))


def status_lookup(orders, wanted=("delivered", "canceled")):
    """Count and percentage of the wanted statuses, zero for an absent one."""
    names = F.array(*[F.lit(s) for s in wanted])
    frame = orders.sparkSession.range(1).select(F.explode(names).alias("order_status"))
    return frame.join(status_distribution(orders), "order_status", "left").select(
        "order_status",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
    )


def payment_totals(payments):
    """Amount paid per order."""
    return payments.groupBy("order_id").agg(
        sum_money(F.col("payment_value")).alias("payment_value")
    )


def payment_histogram(payments, bins=60):
    """Histogram of the order payments up to their 99th percentile."""
    counts = tally(payment_totals(payments), [], "payment_value")
    p99 = quantile_scalar(counts, "payment_value", 0.99)
    return equal_width_bins(counts.filter(F.col("payment_value") <= p99), "payment_value", bins)


def top_categories(tables, k=10):
    """Translated categories by number of distinct orders."""
    translation = tables["category_translation"].withColumnRenamed(
        "product_category_name_english", "category_en"
    )
    products = tables["products"].select("product_id", "product_category_name")
    named = (
        tables["order_items"]
        .select("order_id", "product_id")
        .join(products, "product_id", "left")
        .join(translation, "product_category_name", "left")
        .dropna(subset=["category_en"])
    )
    # distinct (category, order) pairs first: a hot category never meets in one task
    counts = (
        named.groupBy("category_en", "order_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy("category_en")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    return top(counts, k, F.col("n_orders").desc(), F.col("category_en"))


def date_range(orders):
    """First and last purchase and the length of the period."""
    bought = F.col("order_purchase_timestamp")
    ends = orders.agg(F.min(bought).alias("first_order"), F.max(bought).alias("last_order"))
    seconds = seconds_between(F.col("first_order"), F.col("last_order"))
    days = F.floor(seconds / F.lit(86400))
    return ends.withColumn("total_days", days).withColumn(
        "total_years", half_even(F.col("total_days") / F.lit(365.0), 1)
    )


def monthly_orders(orders):
    """Delivered orders per month without the first and the last month present."""
    month = year_month(F.col("order_purchase_timestamp"))
    counts = (
        orders.filter(F.col("order_status") == "delivered")
        .groupBy(month.alias("order_month"))
        .agg(F.count("order_id").alias("n_orders"))
        .filter(F.col("order_month").isNotNull())
    )
    ends = counts.agg(F.struct(F.min("order_month").alias("a"), F.max("order_month").alias("z")))
    inner = counts.withColumn("_ends", ends.scalar())
    return inner.filter("order_month > _ends.a and order_month < _ends.z").drop("_ends")


def peak_months(monthly):
    """The month with the most and the month with the fewest orders, the earlier on ties."""
    n, month = F.col("n_orders"), F.col("order_month")
    peaks = monthly.agg(
        F.min(F.struct((-n).alias("fewest"), month)).alias("_hi"), F.min(F.struct(n, month)).alias("_lo")
    )
    return peaks.select(
        F.col("_hi.order_month").alias("peak_month"),
        (-F.col("_hi.fewest")).alias("peak_orders"),
        F.col("_lo.order_month").alias("low_month"),
        F.col("_lo.n_orders").alias("low_orders"),
    )

