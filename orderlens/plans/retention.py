"""Repeat purchases: order sequence, category retention ranking, Wilson intervals."""

from importlib import resources

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.functions.scalars import avg_money, days_truncated, half_up, sum_money, wilson
from orderlens.operators.positions import number_within
from orderlens.operators.summaries import stack, top
from orderlens.plans.master import dearest_item
from orderlens.sources.tables import run_script

MIN_CUSTOMERS = 50


def customer_orders(tables):
    """Delivered orders under the stable customer id."""
    orders = tables["orders"].filter(F.col("order_status") == "delivered")
    customers = tables["customers"].select("customer_id", "customer_unique_id")
    return orders.join(customers, "customer_id").select(
        "customer_unique_id", "order_id", "order_purchase_timestamp"
    )


def order_sequence(tables):
    """Every delivered order with its place in the customer's history and the history length."""
    return number_within(
        customer_orders(tables),
        "customer_unique_id",
        [F.col("order_purchase_timestamp").asc(), F.col("order_id").asc()],
        into="purchase_rank",
        total_into="total_orders",
    )


def customer_history(tables):
    """One row per customer: first order, first and last purchase, number of orders.

    Plain aggregates, combined before the shuffle; no window is needed for the first order.
    """
    earliest = F.min(F.struct("order_purchase_timestamp", "order_id"))
    return (
        customer_orders(tables)
        .groupBy("customer_unique_id")
        .agg(
            earliest.alias("_first"),
            F.max("order_purchase_timestamp").alias("last_purchase_date"),
            F.count("order_id").alias("total_orders"),
        )
        .select(
            "customer_unique_id",
            F.col("_first.order_id").alias("order_id"),
            F.col("_first.order_purchase_timestamp").alias("first_purchase_date"),
            "last_purchase_date",
            "total_orders",
        )
    )


def returning_customers(tables):
    """Customers with more than one order and the days between their first and last."""
    span = days_truncated(F.col("first_purchase_date"), F.col("last_purchase_date"))
    repeat = customer_history(tables).filter("total_orders > 1")
    return repeat.select(
        "customer_unique_id",
        "total_orders",
        "first_purchase_date",
        "last_purchase_date",
        span.alias("days_between_first_last"),
    )


def first_orders_with_category(tables):
    """Each customer's first order with the category of its main item."""
    translation = tables["category_translation"]
    products = tables["products"].select("product_id", "product_category_name")
    category = F.coalesce("product_category_name_english", F.lit("unknown"))
    return (
        customer_history(tables)
        .join(dearest_item(tables["order_items"]), "order_id")
        .join(products, "product_id", "left")
        .join(translation, "product_category_name", "left")
        .select(
            "customer_unique_id",
            "order_id",
            "first_purchase_date",
            "total_orders",
            category.alias("first_category_en"),
        )
    )


def category_retention(tables, min_customers=MIN_CUSTOMERS):
    """Customers, returning customers and their share per first-purchase category.

    The input has one row per customer, so plain counts are distinct customer counts.
    """
    repeat = F.col("total_orders") > 1
    stats = (
        first_orders_with_category(tables)
        .groupBy(F.col("first_category_en").alias("category"))
        .agg(
            F.count("customer_unique_id").alias("total_customers"),
            F.count(F.when(repeat, F.col("customer_unique_id"))).alias("retained_customers"),
            F.avg(F.when(repeat, F.col("total_orders"))).alias("_orders"),
        )
        .filter(F.col("total_customers") >= min_customers)
    )
    rate = F.try_divide(F.col("retained_customers") * 100.0, F.col("total_customers"))
    return stats.select(
        "category",
        "total_customers",
        "retained_customers",
        half_up(rate, 2).alias("retention_pct"),
        half_up(F.col("_orders"), 2).alias("avg_orders_returning"),
    )


def retention_ranking(tables, min_customers=MIN_CUSTOMERS):
    """Categories ranked by retention and by volume, with retention quartiles.

    The windows span the category dictionary: one row per translated category.
    """
    by_rate = Window.orderBy(F.col("retention_pct").desc())
    quartile = Window.orderBy(F.col("retention_pct").desc(), F.col("category"))
    by_size = Window.orderBy(F.col("total_customers").desc())
    stats = category_retention(tables, min_customers)
    return stats.select(
        F.rank().over(by_rate).alias("retention_rank"),
        "category",
        "total_customers",
        "retained_customers",
        (F.col("total_customers") - F.col("retained_customers")).alias("churned_customers"),
        "retention_pct",
        "avg_orders_returning",
        F.ntile(4).over(quartile).alias("retention_quartile"),
        F.rank().over(by_size).alias("volume_rank"),
    )


def retention_script(tables, min_customers=MIN_CUSTOMERS):
    """The same ranking from the packaged SQL script."""
    text = resources.files("orderlens.plans").joinpath("retention.sql").read_text("utf-8")
    names = ("orders", "customers", "order_items", "products", "category_translation")
    bound = {name: tables[name] for name in names}
    bound["min_customers"] = min_customers
    return run_script(tables["orders"].sparkSession, text, bound)


def first_vs_repeat(tables):
    """Orders, mean value and mean item count by place in the customer's history."""
    per_order = (
        tables["order_items"]
        .groupBy("order_id")
        .agg(
            sum_money(F.col("price")).alias("price_total"),
            F.count("order_item_id").alias("n_items"),
        )
    )
    rank = F.col("purchase_rank")
    kind = (
        F.when(rank == 1, "First purchase")
        .when(rank == 2, "Second purchase")
        .otherwise("Third purchase or more")
    )
    sequence = order_sequence(tables).join(per_order, "order_id")
    return sequence.groupBy("purchase_rank", kind.alias("purchase_type")).agg(
        F.count("order_id").alias("num_orders"),
        half_up(avg_money(F.col("price_total")), 2).alias("avg_order_value"),
        half_up(F.avg("n_items"), 2).alias("avg_items_per_order"),
    )


def global_retention(tables):
    """Retention over all customers with a delivered order."""
    orders = F.col("total_orders")
    stats = customer_history(tables).agg(
        F.count("customer_unique_id").alias("total_customers"),
        F.count_if(orders > 1).alias("retained_customers"),
        F.avg(orders).alias("_mean"),
        F.max(orders).alias("max_orders_single_customer"),
    )
    rate = F.try_divide(F.col("retained_customers") * 100.0, F.col("total_customers"))
    return stats.select(
        "total_customers",
        "retained_customers",
        half_up(rate, 2).alias("global_retention_rate_pct"),
        half_up(F.col("_mean"), 2).alias("avg_orders_per_customer"),
        "max_orders_single_customer",
    )


def retention_rates(ranking, rfm):
    """Retention over the ranked categories only, beside the rate of the whole base."""
    ranked = ranking.agg(
        F.lit("ranked categories").alias("scope"),
        F.sum("retained_customers").alias("retained"),
        F.sum("total_customers").alias("customers"),
    )
    base = rfm.agg(
        F.lit("all customers").alias("scope"),
        F.count_if(F.col("frequency") > 1).alias("retained"),
        F.count("customer_unique_id").alias("customers"),
    )
    rate = F.try_divide(F.col("retained") * 100.0, F.col("customers"))
    return ranked.unionByName(base).withColumn("retention_pct", rate)


def retention_with_ci(ranking, z=1.96):
    low, high = wilson(F.col("retained_customers"), F.col("total_customers"), z)
    return ranking.withColumn("ci95_lo", low).withColumn("ci95_hi", high)


def robust_extremes(with_ci, k=3):
    """The k categories with the highest and the lowest lower bound."""
    cols = ["category", "total_customers", "retention_pct", "ci95_lo", "ci95_hi"]
    high = top(with_ci, k, F.col("ci95_lo").desc(), F.col("category"))
    low = top(with_ci, k, F.col("ci95_lo").asc(), F.col("category").desc())
    return stack(
        high.select(F.lit("highest").alias("side"), *cols),
        low.select(F.lit("lowest").alias("side"), *cols),
    )


def point_extremes(with_ci, k=3):
    """The k categories with the highest and the lowest point estimate, in ranking order on ties."""
    cols = [
        "category",
        "total_customers",
        "retained_customers",
        "retention_pct",
        "avg_orders_returning",
        "ci95_lo",
        "ci95_hi",
    ]
    high = top(with_ci, k, F.col("retention_pct").desc(), F.col("category"))
    low = top(with_ci, k, F.col("retention_pct").asc(), F.col("category"))
    return stack(
        high.select(F.lit("Highest retention").alias("group"), *cols),
        low.select(F.lit("Lowest retention").alias("group"), *cols),
    )
