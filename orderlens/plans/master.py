"""The order-level master table, in its two published forms, and its checks."""

from pyspark.sql import functions as F

from orderlens.functions.scalars import (
    days_floor,
    days_fraction,
    half_even,
    half_up,
    is_negative,
    ratio,
    share_in,
    share_where,
    sum_money,
    weekday_monday0,
    weekday_sunday0_text,
    year_month,
)
from orderlens.operators.quality import funnel, repeated_keys, violations

NEEDED_DATES = ["order_delivered_customer_date", "order_estimated_delivery_date"]

# fixed values: columns of the two forms, in order
SQL_COLUMNS = [
    "order_id",
    "customer_unique_id",
    "customer_state",
    "customer_city",
    "category_en",
    "order_purchase_timestamp",
    "order_month",
    "order_weekday",
    "delivery_days",
    "delivery_delay_days",
    "n_items",
    "price_total",
    "freight_total",
    "freight_ratio",
    "review_score",
    "is_negative_review",
    "review_creation_date",
    "review_answer_timestamp",
    "review_before_delivery",
    "product_weight_g",
]

NOTEBOOK_COLUMNS = [
    "order_id",
    "customer_unique_id",
    "customer_state",
    "customer_city",
    "order_purchase_timestamp",
    "order_month",
    "order_weekday",
    "order_hour",
    "category_en",
    "n_items",
    "price_total",
    "freight_total",
    "freight_ratio",
    "product_weight_g",
    "delivery_days",
    "delivery_delay_days",
    "review_score",
    "is_negative_review",
    "review_creation_date",
    "review_before_delivery",
]


def delivered(orders, need_purchase=False):
    """Delivered orders that carry the dates the features need."""
    dates = NEEDED_DATES + (["order_purchase_timestamp"] if need_purchase else [])
    return orders.filter(F.col("order_status") == "delivered").dropna(subset=dates)


def items_per_order(items, main_item="min"):
    """One row per order: item count, sums and the main product and seller.

    ``min`` takes the smallest ids, ``first`` those of the lowest item number.
    """
    counts = [
        F.count("order_item_id").alias("n_items"),
        sum_money(F.col("price")).alias("price_total"),
        sum_money(F.col("freight_value")).alias("freight_total"),
    ]
    grouped = items.groupBy("order_id")
    if main_item == "min":
        return grouped.agg(
            *counts, F.min("seller_id").alias("seller_id"), F.min("product_id").alias("product_id")
        )
    lead = F.min(F.struct("order_item_id", "product_id", "seller_id")).alias("_lead")
    out = grouped.agg(*counts, lead)
    return out.select(
        "order_id",
        "n_items",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("price_total", "freight_total")],
        F.col("_lead.seller_id").alias("seller_id"),
        F.col("_lead.product_id").alias("product_id"),
    )


def dearest_item(items):
    """The product of the highest-priced item per order, the lower item number on ties."""
    key = F.struct(F.col("price"), -F.col("order_item_id"), F.col("product_id"))
    return items.groupBy("order_id").agg(F.max_by("product_id", key).alias("product_id"))


def latest_review(reviews):
    """The most recently answered review per order, the larger review_id on ties.

    A maximum is combined before the shuffle, so an order with very many reviews is cheap.
    """
    newest = F.max(
        F.struct(
            "review_answer_timestamp", "review_id", "review_score", "review_creation_date"
        )
    )
    return reviews.groupBy("order_id").agg(newest.alias("r")).select("order_id", "r.*")


def product_category(products, translation):
    """Products with their English category; products without one are 'unknown'."""
    named = products.join(translation, "product_category_name", "left")
    return named.select(
        "product_id",
        F.coalesce("product_category_name_english", F.lit("unknown")).alias("category_en"),
        "product_weight_g",
    )


def joined_orders(tables, day_mode="fractional", main_item="min"):
    """Delivered orders with items, category, review and customer, and the day features."""
    floor = day_mode == "floor"
    days = days_floor if floor else days_fraction
    arrival = F.col("order_delivered_customer_date")
    orders = (
        delivered(tables["orders"], need_purchase=floor)
        .withColumn("delivery_days", days(F.col("order_purchase_timestamp"), arrival))
        .withColumn("delivery_delay_days", days(F.col("order_estimated_delivery_date"), arrival))
    )
    customers = tables["customers"].select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state"
    )
    reviews = latest_review(tables["order_reviews"])
    reviews = reviews.withColumn("is_negative_review", is_negative(F.col("review_score")))
    categories = product_category(tables["products"], tables["category_translation"])
    return (
        orders.join(items_per_order(tables["order_items"], main_item), "order_id")
        .join(reviews, "order_id", "left")
        .join(customers, "customer_id")
        .join(categories, "product_id", "left")
    )


def build_master(tables, day_mode="fractional", main_item="min"):
    """One row per delivered order.

    ``fractional`` days follow the SQL form of the table (text weekday from Sunday,
    halves rounded up, 0/1 flags); ``floor`` days follow the notebook form (whole
    days rounded down, weekday number from Monday, halves to even, boolean flag).
    """
    floor = day_mode == "floor"
    bought = F.col("order_purchase_timestamp")
    early = F.coalesce(
        F.col("review_creation_date") < F.col("order_delivered_customer_date"), F.lit(False)
    )
    share = ratio(F.col("freight_total"), F.col("price_total"))
    rows = joined_orders(tables, day_mode, main_item).filter(F.col("delivery_days") > 0)
    rows = rows.withColumns(
        {
            "order_month": year_month(bought),
            "order_weekday": weekday_monday0(bought) if floor else weekday_sunday0_text(bought),
            "order_hour": F.hour(bought),
            "freight_ratio": half_even(share, 4) if floor else half_up(share, 4),
            "review_before_delivery": early if floor else early.cast("int"),
        }
    )
    return rows.select(*(NOTEBOOK_COLUMNS if floor else SQL_COLUMNS))


def master_sql(tables):
    return build_master(tables, "fractional", "min")


def master_notebook(tables):
    return build_master(tables, "floor", "first")


def reviewed(master):
    """Orders of the notebook master that have a review."""
    return master.dropna(subset=["review_score"])


def cleaning_funnel(tables):
    """Rows kept by each cleaning step of the notebook form, counted in one pass."""
    bought, arrival = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    dates = bought.isNotNull() & arrival.isNotNull()
    dates = dates & F.col("order_estimated_delivery_date").isNotNull()
    have_items = tables["order_items"].select("order_id", F.lit(True).alias("_items")).distinct()
    have_customer = tables["customers"].select("customer_id", F.lit(True).alias("_customer"))
    orders = tables["orders"].select(
        "order_id",
        "customer_id",
        (F.col("order_status") == "delivered").alias("_delivered"),
        dates.alias("_dated"),
        (days_floor(bought, arrival) > 0).alias("_plausible"),
    )
    flagged = orders.join(have_items, "order_id", "left").join(have_customer, "customer_id", "left")
    return funnel(
        flagged,
        [
            ("all orders", "true"),
            ("delivered", "_delivered"),
            ("with critical dates", "_dated"),
            ("joined", "_items and _customer"),
            ("delivery days above zero", "_plausible"),
        ],
    )


def review_dedup_counts(tables):
    """Reviews before and after keeping one per order."""
    per_order = tables["order_reviews"].groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_order.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_reviews"),
        F.count(F.lit(1)).alias("kept_reviews"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("removed_reviews"),
    )


def integrity_checks(master):
    """Rows that break a rule of the master table; every count must be zero."""
    rules = violations(
        master,
        {
            "delivery_days above zero": "not delivery_days > 0",
            "review_score in 1..5": "review_score not between 1 and 5",
            "price_total not negative": "not price_total >= 0",
        },
    )
    return rules.unionByName(repeated_keys(master, "order_id", "order_id unique"))


def assert_integrity(master):
    """Raise when a check fails."""
    broken = integrity_checks(master).filter("violations > 0").limit(1).collect()
    if broken:
        raise AssertionError(f"{broken[0]['check']}: {broken[0]['violations']} rows")


def leakage_audit(tables):
    """Share of reviews written before delivery: overall, on late orders, and of those
    the share written after the promised date."""
    rows = joined_orders(tables, "floor", "first").filter(F.col("delivery_days") > 0)
    written = F.col("review_creation_date")
    early = F.coalesce(written < F.col("order_delivered_customer_date"), F.lit(False))
    has_review = F.col("review_score").isNotNull()
    late = has_review & (F.col("delivery_delay_days") > 0)
    overdue = F.coalesce(written > F.col("order_estimated_delivery_date"), F.lit(False))
    return rows.agg(
        F.count_if(has_review).alias("n_reviewed"),
        share_in(early, has_review).alias("share_before"),
        F.count_if(late).alias("n_late"),
        share_in(early, late).alias("share_before_late"),
        F.count_if(late & early).alias("n_before_late"),
        share_in(overdue, late & early).alias("share_after_promise"),
    )


def negative_flag_counts(master):
    """Orders by negative flag with the unreviewed ones counted as null."""
    flag = F.col("is_negative_review")
    return master.agg(
        F.count_if(flag == 1).alias("negative"),
        F.count_if(flag == 0).alias("positive"),
        F.count_if(flag.isNull()).alias("no_review"),
        (share_where(F.coalesce(flag == 1, F.lit(False))) * 100).alias("pct_negative"),
        (share_where(F.coalesce(flag == 0, F.lit(False))) * 100).alias("pct_positive"),
        (share_where(flag.isNull()) * 100).alias("pct_no_review"),
    )
