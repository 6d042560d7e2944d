"""The catalog queries as independent SQL for DuckDB over the generated tables.

Each body names the common tables it needs (``x_...``); ``statement`` puts their
definitions in front.
"""

import re

VIEWS = {}

VIEWS["x_orders"] = """
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END
      AS order_status,
    purchase AS order_purchase_timestamp,
    CASE WHEN o_orderkey % 97 <> 0 THEN purchase + INTERVAL 1 HOUR END AS order_approved_at,
    CASE WHEN o_orderstatus = 'F' THEN purchase + to_hours(transit // 2) END
      AS order_delivered_carrier_date,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 211 <> 0 THEN purchase + to_hours(transit) END
      AS order_delivered_customer_date,
    o_orderdate + to_days((15 + o_orderkey % 11)::INTEGER) AS order_estimated_delivery_date
  FROM (SELECT *, (o_orderkey * 37) % 960 AS transit,
          o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS purchase
        FROM orders)
"""
VIEWS["x_lines"] = """
  SELECT *, round(l_extendedprice * 100)::BIGINT AS cents, round(l_tax * 100)::BIGINT AS tax,
    round(l_discount * 100)::BIGINT AS disc
  FROM lineitem
"""
VIEWS["x_items"] = """
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
    l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, l_extendedprice AS price,
    ((cents * tax + 50) // 100) / 100e0 AS freight_value, cents AS price_cents,
    (cents * tax + 50) // 100 AS freight_cents
  FROM x_lines
"""
VIEWS["x_payments"] = """
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential, l_returnflag AS payment_type,
    (1 + l_linenumber)::INTEGER AS payment_installments,
    ((cents * (100 - disc) + 50) // 100) / 100e0 AS payment_value,
    (cents * (100 - disc) + 50) // 100 AS payment_cents
  FROM x_lines
"""
VIEWS["x_reviews"] = """
  SELECT 'R-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
      || l_quantity::INTEGER AS review_id,
    l_orderkey AS order_id,
    (CASE WHEN l_quantity > 40 THEN 1 + l_quantity::INTEGER % 5
      ELSE 5 - least(4, ((l_orderkey * 37) % 960) // 216) END)::INTEGER AS review_score,
    CASE WHEN l_partkey % 8 = 0 THEN 'title' END AS review_comment_title,
    CASE WHEN l_partkey % 3 <> 0 THEN 'msg' END AS review_comment_message,
    created AS review_creation_date,
    created + to_hours(l_partkey % 72) AS review_answer_timestamp
  FROM (SELECT l.*, date_trunc('day', least(o.order_delivered_customer_date,
            o.order_estimated_delivery_date)) + INTERVAL 1 DAY AS created
        FROM lineitem l JOIN x_orders o ON o.order_id = l.l_orderkey
        WHERE l_returnflag <> 'N')
"""
VIEWS["x_customers"] = """
  SELECT c_custkey AS customer_id,
    CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS customer_unique_id,
    c_name AS customer_city, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
VIEWS["x_products"] = """
  SELECT p_partkey AS product_id,
    CASE WHEN p_partkey % 53 <> 0 THEN p_brand END AS product_category_name,
    (p_size * 100)::DOUBLE AS product_weight_g
  FROM part
"""
VIEWS["x_translation"] = """
  SELECT DISTINCT p_brand AS product_category_name,
    lower(replace(p_brand, '#', '_')) AS product_category_name_english
  FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13')
"""
VIEWS["x_sellers"] = """
  SELECT s_suppkey AS seller_id, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
VIEWS["x_geolocation"] = """
  SELECT c_nationkey AS zip_prefix, c_nationkey * 1e0 AS lat, c_nationkey * -1e0 AS lng,
    n_name AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
VIEWS["x_latest"] = """
  SELECT order_id, review_answer_timestamp, review_id, review_score, review_creation_date
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id
          ORDER BY review_answer_timestamp DESC NULLS LAST, review_id DESC) AS rn
        FROM x_reviews)
  WHERE rn = 1
"""
VIEWS["x_category"] = """
  SELECT p.product_id, coalesce(t.product_category_name_english, 'unknown') AS category_en,
    p.product_weight_g
  FROM x_products p LEFT JOIN x_translation t USING (product_category_name)
"""
VIEWS["x_items_min"] = """
  SELECT order_id, count(order_item_id) AS n_items, sum(price_cents)::BIGINT / 100e0 AS price_total,
    sum(freight_cents)::BIGINT / 100e0 AS freight_total, min(seller_id) AS seller_id,
    min(product_id) AS product_id
  FROM x_items GROUP BY order_id
"""
VIEWS["x_items_first"] = """
  SELECT order_id, n_items, price_total, freight_total, seller_id, product_id
  FROM (SELECT order_id, product_id, seller_id,
          count(order_item_id) OVER w AS n_items,
          sum(price_cents) OVER w::BIGINT / 100e0 AS price_total,
          sum(freight_cents) OVER w::BIGINT / 100e0 AS freight_total,
          row_number() OVER (PARTITION BY order_id
            ORDER BY order_item_id, product_id, seller_id) AS rn
        FROM x_items WINDOW w AS (PARTITION BY order_id))
  WHERE rn = 1
"""
VIEWS["x_main_item"] = """
  SELECT order_id, product_id
  FROM (SELECT order_id, product_id, row_number() OVER (PARTITION BY order_id
          ORDER BY price DESC, order_item_id, product_id DESC) AS rn FROM x_items)
  WHERE rn = 1
"""
VIEWS["x_delivered"] = """
  SELECT *, date_diff('second', order_purchase_timestamp, order_delivered_customer_date) AS took,
    date_diff('second', order_estimated_delivery_date, order_delivered_customer_date) AS behind
  FROM x_orders
  WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
    AND order_estimated_delivery_date IS NOT NULL AND order_purchase_timestamp IS NOT NULL
"""
VIEWS["x_master_sql"] = """
  SELECT o.order_id, c.customer_unique_id, c.customer_state, c.customer_city, g.category_en,
    o.order_purchase_timestamp, strftime(o.order_purchase_timestamp, '%Y-%m') AS order_month,
    strftime(o.order_purchase_timestamp, '%w') AS order_weekday,
    o.took / 86400e0 AS delivery_days, o.behind / 86400e0 AS delivery_delay_days,
    i.n_items, i.price_total, i.freight_total,
    floor(i.freight_total / nullif(i.price_total, 0) * 1e4 + 5e-1) / 1e4 AS freight_ratio,
    r.review_score,
    CASE WHEN r.review_score <= 2 THEN 1 WHEN r.review_score > 2 THEN 0 END AS is_negative_review,
    r.review_creation_date, r.review_answer_timestamp,
    CASE WHEN r.review_creation_date < o.order_delivered_customer_date THEN 1 ELSE 0 END
      AS review_before_delivery,
    g.product_weight_g
  FROM x_delivered o JOIN x_items_min i USING (order_id)
    LEFT JOIN x_category g ON g.product_id = i.product_id
    LEFT JOIN x_latest r ON r.order_id = o.order_id
    JOIN x_customers c ON c.customer_id = o.customer_id
  WHERE o.took > 0
"""
VIEWS["x_joined"] = """
  SELECT o.order_id, c.customer_unique_id, c.customer_state, c.customer_city,
    o.order_purchase_timestamp, strftime(o.order_purchase_timestamp, '%Y-%m') AS order_month,
    (isodow(o.order_purchase_timestamp) - 1)::INTEGER AS order_weekday,
    hour(o.order_purchase_timestamp)::INTEGER AS order_hour, g.category_en, i.n_items,
    i.price_total, i.freight_total,
    round_even((i.freight_total / nullif(i.price_total, 0) * 1e4)::DOUBLE, 0) / 1e4
      AS freight_ratio,
    g.product_weight_g, floor(o.took / 86400e0)::INTEGER AS delivery_days,
    floor(o.behind / 86400e0)::INTEGER AS delivery_delay_days, r.review_score,
    CASE WHEN r.review_score <= 2 THEN 1 WHEN r.review_score > 2 THEN 0 END AS is_negative_review,
    r.review_creation_date,
    coalesce(r.review_creation_date < o.order_delivered_customer_date, false)
      AS review_before_delivery,
    o.order_estimated_delivery_date
  FROM x_delivered o JOIN x_items_first i USING (order_id)
    LEFT JOIN x_category g ON g.product_id = i.product_id
    LEFT JOIN x_latest r ON r.order_id = o.order_id
    JOIN x_customers c ON c.customer_id = o.customer_id
"""
VIEWS["x_master"] = (
    "SELECT * EXCLUDE (order_estimated_delivery_date) FROM x_joined WHERE delivery_days > 0"
)
VIEWS["x_rev"] = "SELECT * FROM x_master WHERE review_score IS NOT NULL"
VIEWS["x_sequence"] = """
  SELECT c.customer_unique_id, o.order_id, o.order_purchase_timestamp,
    row_number() OVER (PARTITION BY c.customer_unique_id
      ORDER BY o.order_purchase_timestamp, o.order_id) AS purchase_rank,
    count(*) OVER (PARTITION BY c.customer_unique_id) AS total_orders
  FROM x_orders o JOIN x_customers c USING (customer_id)
  WHERE o.order_status = 'delivered'
"""
VIEWS["x_first_category"] = """
  SELECT s.customer_unique_id, s.order_id, s.order_purchase_timestamp AS first_purchase_date,
    s.total_orders, coalesce(t.product_category_name_english, 'unknown') AS first_category_en
  FROM x_sequence s JOIN x_main_item i ON i.order_id = s.order_id
    LEFT JOIN x_products p ON p.product_id = i.product_id
    LEFT JOIN x_translation t ON t.product_category_name = p.product_category_name
  WHERE s.purchase_rank = 1
"""
VIEWS["x_retention"] = """
  SELECT rank() OVER (ORDER BY retention_pct DESC)::INTEGER AS retention_rank, category,
    total_customers, retained_customers,
    total_customers - retained_customers AS churned_customers, retention_pct,
    avg_orders_returning,
    ntile(4) OVER (ORDER BY retention_pct DESC, category)::INTEGER AS retention_quartile,
    rank() OVER (ORDER BY total_customers DESC)::INTEGER AS volume_rank
  FROM (SELECT first_category_en AS category,
          count(DISTINCT customer_unique_id) AS total_customers,
          count(DISTINCT CASE WHEN total_orders > 1 THEN customer_unique_id END)
            AS retained_customers,
          floor(count(DISTINCT CASE WHEN total_orders > 1 THEN customer_unique_id END) * 100e0
            / count(DISTINCT customer_unique_id) * 1e2 + 5e-1) / 1e2 AS retention_pct,
          floor(avg(CASE WHEN total_orders > 1 THEN total_orders END) * 1e2 + 5e-1) / 1e2
            AS avg_orders_returning
        FROM x_first_category GROUP BY 1
        HAVING count(DISTINCT customer_unique_id) >= 50)
"""
VIEWS["x_ci"] = """
  SELECT *, greatest(0e0, mid - reach) * 100 AS ci95_lo, least(1e0, mid + reach) * 100 AS ci95_hi
  FROM (SELECT *, (p + 1.96e0 * 1.96e0 / (2 * n)) / (1 + 1.96e0 * 1.96e0 / n) AS mid,
          1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4 * n * n))
            / (1 + 1.96e0 * 1.96e0 / n) AS reach
        FROM (SELECT *, total_customers::DOUBLE AS n,
                retained_customers / total_customers::DOUBLE AS p FROM x_retention))
"""
VIEWS["x_metrics"] = """
  SELECT customer_unique_id, count(DISTINCT order_id) AS frequency,
    sum(round(price_total * 100)::BIGINT)::BIGINT AS cents,
    sum(round(price_total * 100)::BIGINT)::BIGINT / 100e0 AS monetary,
    floor(date_diff('second', max(order_purchase_timestamp),
      (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY FROM x_master)) / 86400e0)::INTEGER
      AS recency
  FROM x_master GROUP BY customer_unique_id
"""
VIEWS["x_rfm"] = """
  SELECT *, CASE WHEN "R_score" >= 4 AND "F_score" >= 4 THEN 'Champions'
      WHEN "F_score" >= 3 AND "R_score" >= 3 THEN 'Loyal'
      WHEN "R_score" >= 4 AND "F_score" = 1 THEN 'New Customers'
      WHEN "R_score" <= 2 AND "F_score" >= 3 THEN 'At Risk'
      WHEN "R_score" <= 2 AND "F_score" <= 2 THEN 'Lost' ELSE 'Others' END AS segment,
    round_even((("R_score" + "F_score" + "M_score") / 3e0 * 1e2)::DOUBLE, 0) / 1e2 AS "RFM_score",
    "R_score" || '' || "F_score" || '' || "M_score" AS "RFM_string"
  FROM (SELECT customer_unique_id, frequency, cents, monetary, recency,
          greatest(1, ceil(5e0 * (rr - 1) / (n - 1)))::INTEGER AS "R_score",
          CASE frequency WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END AS "F_score",
          greatest(1, ceil(5e0 * (rm - 1) / (n - 1)))::INTEGER AS "M_score"
        FROM (SELECT *, count(*) OVER () AS n,
                row_number() OVER (ORDER BY recency DESC, customer_unique_id) AS rr,
                row_number() OVER (ORDER BY monetary, customer_unique_id) AS rm
              FROM x_metrics))
"""
VIEWS["x_paid"] = """
  SELECT order_id, sum(payment_cents)::BIGINT / 100e0 AS payment_value FROM x_payments
  GROUP BY order_id
"""
VIEWS["x_eda"] = """
  SELECT o.order_id,
    floor(date_diff('second', order_purchase_timestamp, order_delivered_customer_date)
      / 86400e0)::INTEGER AS delivery_days,
    floor(date_diff('second', order_estimated_delivery_date, order_delivered_customer_date)
      / 86400e0)::INTEGER AS delay_days,
    r.review_score, p.payment_value, p.payment_installments, i.n_items, i.price_total,
    i.freight_total
  FROM x_orders o
    JOIN (SELECT order_id, avg(review_score) AS review_score FROM x_reviews GROUP BY 1) r
      USING (order_id)
    LEFT JOIN (SELECT order_id, sum(payment_cents)::BIGINT / 100e0 AS payment_value,
                 max(payment_installments) AS payment_installments
               FROM x_payments GROUP BY 1) p USING (order_id)
    LEFT JOIN x_items_min i USING (order_id)
  WHERE o.order_delivered_customer_date IS NOT NULL
"""

FEATURES = (
    "delivery_delay_days delivery_days freight_ratio freight_total price_total n_items "
    "product_weight_g order_weekday order_hour"
).split()
CANDIDATES = "delivery_days delivery_delay_days n_items freight_total freight_ratio price_total".split()
HEATMAP = (
    "review_score is_negative_review delivery_delay_days delivery_days freight_ratio "
    "freight_total price_total n_items product_weight_g"
).split()
EDA = (
    "review_score delivery_days delay_days payment_value payment_installments n_items "
    "price_total freight_total"
).split()


def _pairs(columns, table):
    cells = ", ".join(
        f"({i}, '{a}', {j}, '{b}')" for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j
    )
    values = ", ".join(f"{c}::DOUBLE" for c in columns)
    return f"""
      SELECT a, b, count(*) AS n, round(corr(v[i + 1], v[j + 1]), 8) + 0e0 AS r
      FROM (SELECT [{values}] AS v FROM {table}), (VALUES {cells}) t(i, a, j, b)
      WHERE v[i + 1] IS NOT NULL AND v[j + 1] IS NOT NULL
      GROUP BY a, b"""


def _rhos(columns, table="x_rev", target="review_score"):
    """Rho by average ranks inside the complete pairs, p by integrating the null density."""
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, {target}::DOUBLE AS y FROM {table} "
        f"WHERE {c} IS NOT NULL AND {target} IS NOT NULL"
        for c in columns
    )
    return f"""
      SELECT feature, n, rho, (
          SELECT 2 * exp(lgamma((n - 1) / 2e0) - lgamma((n - 2) / 2e0)) / sqrt(pi()) * w / 12000e0
            * sum((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                * pow(greatest(0e0, 1 - pow(abs(rho) + w * k / 4000e0, 2)), (n - 4) / 2e0))
          FROM range(4001) s(k)) AS p_value, (
          SELECT greatest(0e0, -(ln(2e0) + lgamma((n - 1) / 2e0) - lgamma((n - 2) / 2e0) - ln(pi()) / 2 + ln(near / 12000e0)
            + (n - 4) / 2e0 * ln(1 - rho * rho)
            + ln(sum((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                * pow(greatest(0e0, 1 - pow(abs(rho) + near * k / 4000e0, 2)) / (1 - rho * rho), (n - 4) / 2e0)))) / ln(10e0))
          FROM range(4001) s(k)) AS neg_log10_p
      FROM (SELECT *, least(1 - abs(rho), 12 / sqrt(n)) AS w,
              least(1 - abs(rho), 12 / sqrt(n), 60 * (1 - rho * rho) / (n * abs(rho))) AS near
            FROM (SELECT feature, count(*) AS n, corr(rx, ry) AS rho
                  FROM (SELECT feature,
                          rank() OVER (PARTITION BY feature ORDER BY x)
                            + (count(*) OVER (PARTITION BY feature, x) - 1) / 2e0 AS rx,
                          rank() OVER (PARTITION BY feature ORDER BY y)
                            + (count(*) OVER (PARTITION BY feature, y) - 1) / 2e0 AS ry
                        FROM ({long}))
                  GROUP BY feature))"""


def _upper_tail(z):
    """Normal upper tail by integrating the density."""
    return f"""(SELECT CASE WHEN {z} < 0 THEN 1 - s ELSE s END FROM (
        SELECT 14 / 12000e0 / sqrt(2 * pi())
          * sum((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
              * exp(-pow(abs({z}) + 14e0 * k / 4000e0, 2) / 2)) AS s
        FROM range(4001) g(k)))"""


def _upper_log10(z):
    """-log10 of the normal upper tail by integrating the density over its value at z."""
    return f"""(SELECT CASE WHEN {z} < 0 THEN -log10(1 - exp(-{z} * {z} / 2) * s) ELSE ({z} * {z} / 2 - ln(s)) / ln(10e0) END
        FROM (SELECT 14 / 12000e0 / sqrt(2 * pi())
          * sum((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
              * exp(-abs({z}) * (14e0 * k / 4000e0) - pow(14e0 * k / 4000e0, 2) / 2)) AS s
        FROM range(4001) g(k)))"""


def _box(value, groups, table, places=8):
    by = f"PARTITION BY {groups}" if groups else ""
    lead = f"{groups}, " if groups else ""
    tail = f"GROUP BY {groups}" if groups else ""

    def r(x):
        return f"round({x}, {places}) + 0e0"

    return f"""
      SELECT {lead}count(*) AS n, {r("max(q1)")} AS q1, {r("max(q2)")} AS median,
        {r("max(q3)")} AS q3,
        {r("least(max(q1), min(v) FILTER (v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)))")}
          AS whisker_low,
        {r("greatest(max(q3), max(v) FILTER (v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)))")}
          AS whisker_high,
        count(*) FILTER (NOT (v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)))
          AS n_outliers
      FROM (SELECT *, quantile_cont(v, 0.25) OVER ({by}) AS q1,
              quantile_cont(v, 0.5) OVER ({by}) AS q2, quantile_cont(v, 0.75) OVER ({by}) AS q3
            FROM (SELECT {lead}{value}::DOUBLE AS v FROM {table} WHERE {value} IS NOT NULL))
      {tail}"""


def _describe(table, columns, probs, places):
    def one(c):
        cuts = ", ".join(
            f"round(quantile_cont({c}::DOUBLE, {p}), {places}) + 0e0 AS p{p * 100:g}" for p in probs
        )
        return f"""SELECT '{c}' AS "column", count({c}) AS count,
            round(avg({c}), {places}) + 0e0 AS mean, round(stddev_samp({c}), {places}) + 0e0 AS std,
            round(min({c})::DOUBLE, {places}) + 0e0 AS min, {cuts},
            round(max({c})::DOUBLE, {places}) + 0e0 AS max FROM {table}"""

    return " UNION ALL ".join(one(c) for c in columns)


def _bins(source, places):
    """60 equal bins over the values v of a source query."""
    return f"""
      SELECT bin::INTEGER AS bin, round(lo + (hi - lo) * bin / 60, {places}) + 0e0 AS bin_start,
        round(lo + (hi - lo) * (bin + 1) / 60, {places}) + 0e0 AS bin_end, coalesce(c, 0) AS n
      FROM range(60) b(bin)
        CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM ({source}))
        LEFT JOIN (SELECT least(59, floor((v - lo) * 60 / (hi - lo)))::INTEGER AS k, count(*) AS c
                   FROM ({source}), (SELECT min(v) AS lo, max(v) AS hi FROM ({source}))
                   GROUP BY 1) ON k = bin"""


def _profile(name, columns):
    def one(i, c):
        column, dtype = c
        return f"""SELECT '{name}' AS "table", {i}::INTEGER AS position, '{column}' AS "column",
            '{dtype}' AS dtype, count(*) - count({column}) AS nulls,
            round_even(((count(*) - count({column})) / count(*)::DOUBLE * 100 * 1e2)::DOUBLE, 0)
              / 1e2 AS null_pct,
            count(DISTINCT {column}) AS distinct_values FROM x_{SHORT[name]}"""

    return " UNION ALL ".join(one(i, c) for i, c in enumerate(columns))


SHORT = {
    "category_translation": "translation",
    "customers": "customers",
    "geolocation": "geolocation",
    "order_items": "items",
    "order_payments": "payments",
    "order_reviews": "reviews",
    "orders": "orders",
    "products": "products",
    "sellers": "sellers",
}
COLUMNS = {
    "category_translation": [
        ("product_category_name", "string"),
        ("product_category_name_english", "string"),
    ],
    "customers": [
        ("customer_id", "bigint"),
        ("customer_unique_id", "bigint"),
        ("customer_city", "string"),
        ("customer_state", "string"),
    ],
    "geolocation": [
        ("zip_prefix", "int"),
        ("lat", "double"),
        ("lng", "double"),
        ("state", "string"),
    ],
    "order_items": [
        ("order_id", "bigint"),
        ("order_item_id", "int"),
        ("product_id", "bigint"),
        ("seller_id", "bigint"),
        ("shipping_limit_date", "timestamp_ntz"),
        ("price", "double"),
        ("freight_value", "double"),
    ],
    "order_payments": [
        ("order_id", "bigint"),
        ("payment_sequential", "int"),
        ("payment_type", "string"),
        ("payment_installments", "int"),
        ("payment_value", "double"),
    ],
    "order_reviews": [
        ("review_id", "string"),
        ("order_id", "bigint"),
        ("review_score", "int"),
        ("review_comment_title", "string"),
        ("review_comment_message", "string"),
        ("review_creation_date", "timestamp_ntz"),
        ("review_answer_timestamp", "timestamp_ntz"),
    ],
    "orders": [
        ("order_id", "bigint"),
        ("customer_id", "bigint"),
        ("order_status", "string"),
        ("order_purchase_timestamp", "timestamp_ntz"),
        ("order_approved_at", "timestamp_ntz"),
        ("order_delivered_carrier_date", "timestamp_ntz"),
        ("order_delivered_customer_date", "timestamp_ntz"),
        ("order_estimated_delivery_date", "timestamp_ntz"),
    ],
    "products": [
        ("product_id", "bigint"),
        ("product_category_name", "string"),
        ("product_weight_g", "double"),
    ],
    "sellers": [("seller_id", "bigint"), ("seller_state", "string")],
}


def _all_tables(make):
    return " UNION ALL ".join(make(name, cols) for name, cols in COLUMNS.items())


RFM_COLUMNS = (
    'customer_unique_id, frequency, monetary, recency, "R_score", "F_score", "M_score", '
    '"RFM_score", "RFM_string", segment'
)
SCATTER = "((customer_unique_id + 42) * 48271) % 2147483647"
CATEGORY_RATES = """
  SELECT category_en, count(*) AS n_orders, round(avg(is_negative_review), 8) + 0e0 AS neg_review_rate,
    round(avg(delivery_delay_days), 8) + 0e0 AS avg_delay, round(avg(review_score), 8) + 0e0 AS avg_score
  FROM x_rev WHERE category_en IS NOT NULL GROUP BY category_en HAVING count(*) >= 120"""
DRIVERS = f"""
  SELECT feature AS variable, rho AS spearman_rho, p_value, neg_log10_p,
    least(1e0, min(p_value * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW
      AND UNBOUNDED FOLLOWING)) AS "p_value_BH"
  FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, feature) AS place
        FROM ({_rhos(CANDIDATES)}))"""
SATISFACTION = """
  SELECT segment, count(*) AS n_orders, avg(is_negative_review) AS neg_review_rate,
    avg(review_score) AS avg_score, avg(delivery_delay_days) AS avg_delay
  FROM x_rev JOIN x_rfm USING (customer_unique_id) GROUP BY segment"""
POINT_EXTREMES = """
  SELECT * FROM (SELECT 'Highest retention' AS "group", * FROM x_ci
    ORDER BY retention_pct DESC, category LIMIT 3)
  UNION ALL
  SELECT * FROM (SELECT 'Lowest retention' AS "group", * FROM x_ci
    ORDER BY retention_pct, category LIMIT 3)"""

BODIES = {}

_loaded = _all_tables(
    lambda name, cols: f"""SELECT '{name}' AS "table", 'loaded' AS status, count(*) AS rows
      FROM x_{SHORT[name]}"""
    if name != "sellers"
    else """SELECT 'sellers' AS "table", 'skipped' AS status, NULL::BIGINT AS rows"""
)
BODIES["load_report"] = _loaded
BODIES["csv_round_trip"] = "SELECT * FROM x_orders"
_rescued = """
  SELECT order_id, 'order_purchase_timestamp' AS "column",
    CASE WHEN order_id % 7 = 0 THEN 'not a date' ELSE '2017-13-45 10:00:00' END AS value
  FROM x_orders WHERE order_id % 7 = 0 OR order_id % 11 = 0
  UNION ALL
  SELECT order_id, 'order_delivered_customer_date', '31/12/2017' FROM x_orders WHERE order_id % 5 = 0"""
BODIES["csv_rescued"] = _rescued
BODIES["csv_rejects"] = f"""
  SELECT 'orders' AS "table", (SELECT count(*) FROM x_orders) AS rows, c AS "column",
    (SELECT count(*) FROM ({_rescued}) WHERE "column" = c) AS rejected
  FROM (VALUES ('order_id'), ('customer_id'), ('order_purchase_timestamp'), ('order_approved_at'),
    ('order_delivered_carrier_date'), ('order_delivered_customer_date'),
    ('order_estimated_delivery_date')) v(c)"""
BODIES["export_receipt"] = """
  SELECT 'master_csv' AS name, count(*) AS rows, 20::INTEGER AS columns FROM x_master
  UNION ALL SELECT 'master', count(*), 20::INTEGER FROM x_master
  UNION ALL SELECT 'rfm', count(*), 10::INTEGER FROM x_rfm
  UNION ALL SELECT 'rfm_segments', count(DISTINCT segment), 8::INTEGER FROM x_rfm"""
BODIES["table_shapes"] = _all_tables(
    lambda name, cols: f"""SELECT '{name}' AS "table", count(*) AS rows,
      {len(cols)}::INTEGER AS columns FROM x_{SHORT[name]}"""
)
BODIES["quality_all_tables"] = _all_tables(_profile)
BODIES["duplicates_all_tables"] = _all_tables(
    lambda name, cols: f"""SELECT '{name}' AS "table", sum(c)::BIGINT AS rows,
      sum(c - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS c FROM x_{SHORT[name]}
      GROUP BY {", ".join(c for c, _ in cols)})"""
)
_master_columns = (
    "order_id customer_unique_id customer_state customer_city order_purchase_timestamp order_month "
    "order_weekday order_hour category_en n_items price_total freight_total freight_ratio "
    "product_weight_g delivery_days delivery_delay_days review_score is_negative_review "
    "review_creation_date review_before_delivery"
).split()
BODIES["residual_nulls"] = (
    'SELECT * FROM ('
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM x_master"""
        for c in _master_columns
    )
    + ") WHERE nulls > 0"
)
BODIES["cleaning_funnel"] = """
  SELECT step, label, rows, round(rows * 100e0 / (SELECT count(*) FROM x_orders), 8) + 0e0
      AS pct_of_first
  FROM (
    SELECT 0::INTEGER AS step, 'all orders' AS label, count(*) AS rows FROM x_orders
    UNION ALL SELECT 1, 'delivered', count(*) FROM x_orders WHERE order_status = 'delivered'
    UNION ALL SELECT 2, 'with critical dates', count(*) FROM x_delivered
    UNION ALL SELECT 3, 'joined', count(*) FROM x_joined
    UNION ALL SELECT 4, 'delivery days above zero', count(*) FROM x_master)"""
BODIES["review_dedup"] = """
  SELECT count(*) AS total_reviews, count(DISTINCT order_id) AS kept_reviews,
    count(*) - count(DISTINCT order_id) AS removed_reviews FROM x_reviews"""
BODIES["integrity_checks"] = """
  SELECT 'order_id unique' AS "check", count(*) - count(DISTINCT order_id) AS violations FROM x_master
  UNION ALL SELECT 'delivery_days above zero', count(*) FILTER (delivery_days <= 0) FROM x_master
  UNION ALL SELECT 'review_score in 1..5', count(*) FILTER (review_score NOT BETWEEN 1 AND 5)
    FROM x_master
  UNION ALL SELECT 'price_total not negative', count(*) FILTER (price_total < 0) FROM x_master"""
BODIES["leakage_audit"] = """
  SELECT count(*) AS n_reviewed, round(avg(early::INTEGER), 8) + 0e0 AS share_before,
    count(*) FILTER (late) AS n_late,
    round(avg(early::INTEGER) FILTER (late), 8) + 0e0 AS share_before_late,
    count(*) FILTER (late AND early) AS n_before_late,
    round(avg(overdue::INTEGER) FILTER (late AND early), 8) + 0e0 AS share_after_promise
  FROM (SELECT review_before_delivery AS early, delivery_delay_days > 0 AS late,
          review_creation_date > order_estimated_delivery_date AS overdue
        FROM x_joined WHERE delivery_days > 0 AND review_score IS NOT NULL)"""
BODIES["unknown_categories"] = """
  SELECT count(*) FILTER (category_en = 'unknown') AS untranslated_products,
    count(DISTINCT category_en) AS categories FROM x_category"""

BODIES["items_per_order"] = "SELECT * FROM x_items_min"
BODIES["items_per_order_first"] = "SELECT * FROM x_items_first"
BODIES["latest_review"] = "SELECT * FROM x_latest"
BODIES["main_item"] = "SELECT * FROM x_main_item"
BODIES["product_category"] = "SELECT * FROM x_category"
BODIES["master_sql"] = "SELECT * FROM x_master_sql"
BODIES["master_notebook"] = "SELECT * FROM x_master"
BODIES["negative_flag_counts"] = """
  SELECT count(*) FILTER (is_negative_review = 1) AS negative,
    count(*) FILTER (is_negative_review = 0) AS positive,
    count(*) FILTER (is_negative_review IS NULL) AS no_review,
    round(count(*) FILTER (is_negative_review = 1) / count(*)::DOUBLE * 100, 8) + 0e0 AS pct_negative,
    round(count(*) FILTER (is_negative_review = 0) / count(*)::DOUBLE * 100, 8) + 0e0 AS pct_positive,
    round(count(*) FILTER (is_negative_review IS NULL) / count(*)::DOUBLE * 100, 8) + 0e0
      AS pct_no_review
  FROM x_master"""
BODIES["first_months"] = "SELECT DISTINCT order_month FROM x_master ORDER BY order_month LIMIT 8"
BODIES["numeric_columns"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "values" FROM x_rev"""
    for c in (
        "order_id customer_unique_id order_weekday order_hour n_items price_total freight_total "
        "freight_ratio product_weight_g delivery_days delivery_delay_days review_score "
        "is_negative_review"
    ).split()
)
BODIES["feature_summary"] = _describe(
    "x_master",
    ["delivery_days", "delivery_delay_days", "price_total", "freight_ratio", "review_score", "n_items"],
    (0.25, 0.5, 0.75),
    2,
)

BODIES["score_distribution"] = """
  SELECT review_score, count(*) AS n,
    round_even((count(*) * 100e0 / (SELECT count(*) FROM x_reviews) * 1e1)::DOUBLE, 0) / 1e1 AS pct
  FROM x_reviews GROUP BY review_score"""
BODIES["score_summary"] = f"""
  SELECT round_even((avg(review_score) * 1e2)::DOUBLE, 0) / 1e2 AS mean_score,
    quantile_cont(review_score, 0.5)::DOUBLE AS median_score,
    (SELECT round(sum(pct), 1) FROM ({BODIES["score_distribution"]}) WHERE review_score <= 2)
      AS pct_negative
  FROM x_reviews"""
BODIES["status_distribution"] = """
  SELECT order_status, count(*) AS n,
    round_even((count(*) * 100e0 / (SELECT count(*) FROM x_orders) * 1e2)::DOUBLE, 0) / 1e2 AS pct
  FROM x_orders GROUP BY order_status"""
BODIES["status_lookup"] = (
    f"SELECT * FROM ({BODIES['status_distribution']}) WHERE order_status IN ('delivered', 'canceled')"
)
BODIES["payment_describe"] = _describe(
    "x_paid", ["payment_value"], (0.25, 0.5, 0.75, 0.9, 0.95, 0.99), 4
)
BODIES["payment_histogram"] = _bins(
    "SELECT payment_value AS v FROM x_paid "
    "WHERE payment_value <= (SELECT quantile_cont(payment_value, 0.99) FROM x_paid)",
    4,
)
BODIES["payment_box"] = _box("payment_value", "", "x_paid", 4)
BODIES["payment_outliers"] = """
  SELECT order_id, payment_value
  FROM x_paid, (SELECT quantile_cont(payment_value, 0.25) AS q1,
                  quantile_cont(payment_value, 0.75) AS q3 FROM x_paid)
  WHERE payment_value NOT BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)"""
BODIES["eda_order_frame"] = "SELECT * REPLACE (round(review_score, 8) + 0e0 AS review_score) FROM x_eda"
BODIES["eda_pearson"] = _pairs(EDA, "x_eda")
BODIES["eda_score_correlations"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS other, count(*) AS n, round(corr(review_score, {c}), 8) + 0e0 AS r FROM x_eda
      WHERE {c} IS NOT NULL"""
    for c in EDA[1:]
)
BODIES["top_categories"] = """
  SELECT t.product_category_name_english AS category_en, count(DISTINCT i.order_id) AS n_orders
  FROM x_items i JOIN x_products p USING (product_id) JOIN x_translation t USING (product_category_name)
  GROUP BY 1 ORDER BY n_orders DESC, category_en LIMIT 10"""
BODIES["date_range"] = """
  SELECT first_order, last_order, days AS total_days,
    round_even((days / 365e0 * 1e1)::DOUBLE, 0) / 1e1 AS total_years
  FROM (SELECT min(order_purchase_timestamp) AS first_order,
          max(order_purchase_timestamp) AS last_order,
          date_diff('second', min(order_purchase_timestamp), max(order_purchase_timestamp))
            // 86400 AS days
        FROM x_orders)"""
BODIES["monthly_orders"] = """
  SELECT order_month, n_orders
  FROM (SELECT *, min(order_month) OVER () AS lo, max(order_month) OVER () AS hi
        FROM (SELECT strftime(order_purchase_timestamp, '%Y-%m') AS order_month,
                count(*) AS n_orders
              FROM x_orders WHERE order_status = 'delivered' GROUP BY 1))
  WHERE order_month > lo AND order_month < hi"""
BODIES["peak_months"] = f"""
  SELECT hi.order_month AS peak_month, hi.n_orders AS peak_orders, lo.order_month AS low_month,
    lo.n_orders AS low_orders
  FROM (SELECT * FROM ({BODIES["monthly_orders"]}) ORDER BY n_orders DESC, order_month LIMIT 1) hi,
    (SELECT * FROM ({BODIES["monthly_orders"]}) ORDER BY n_orders, order_month LIMIT 1) lo"""

BODIES["negative_total"] = """
  SELECT count(*) AS n_reviewed, sum(is_negative_review)::BIGINT AS n_negative,
    round(avg(is_negative_review) * 100, 8) + 0e0 AS pct_negative FROM x_rev"""
BODIES["driver_pearson"] = _pairs(HEATMAP, "x_rev")
BODIES["delay_days_correlation"] = _pairs(["delivery_delay_days", "delivery_days"], "x_rev")
BODIES["spearman_scores"] = f"""
  SELECT feature, n, round(rho, 8) + 0e0 AS rho, round(p_value, 8) + 0e0 AS p_value,
    round(neg_log10_p, 5) + 0e0 AS neg_log10_p
  FROM ({_rhos(FEATURES)})"""
BODIES["leakage_spearman"] = f"""
  SELECT a.n AS n_all, c.n AS n_clean, round(a.rho, 6) + 0e0 AS rho_all,
    round(c.rho, 6) + 0e0 AS rho_clean, round(a.p_value, 6) + 0e0 AS p_all,
    round(c.p_value, 6) + 0e0 AS p_clean, round(a.neg_log10_p, 5) + 0e0 AS neg_log10_p_all,
    round(c.neg_log10_p, 5) + 0e0 AS neg_log10_p_clean, a.n - c.n AS n_before_delivery,
    round(c.n / a.n::DOUBLE, 6) + 0e0 AS share_clean,
    round(abs(a.rho / c.rho), 6) + 0e0 AS weakening
  FROM ({_rhos(["delivery_delay_days"])}) a, ({_rhos(["delivery_delay_days"],
        "(SELECT * FROM x_rev WHERE NOT review_before_delivery)")}) c"""
BODIES["delay_mann_whitney"] = f"""
  SELECT n1, n2, round(mean1, 6) + 0e0 AS mean1, round(mean2, 6) + 0e0 AS mean2,
    round(u, 6) + 0e0 AS u, round(z, 6) + 0e0 AS z,
    round({_upper_tail("z")}, 6) + 0e0 AS p_value, round({_upper_log10("z")}, 5) + 0e0 AS neg_log10_p,
    round(1 - 2 * u / (n1::DOUBLE * n2), 6) + 0e0 AS rank_biserial
  FROM (SELECT *, (u - n1::DOUBLE * n2 / 2 - 5e-1) / sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1
          - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z
    FROM (SELECT n1, n2, mean1, mean2, ties, r1 - n1::DOUBLE * (n1 + 1) / 2 AS u
      FROM (SELECT count(*) FILTER (low) AS n1, count(*) FILTER (NOT low) AS n2,
              avg(v) FILTER (low) AS mean1, avg(v) FILTER (NOT low) AS mean2,
              sum(r) FILTER (low) AS r1, sum(t * t - 1) AS ties
            FROM (SELECT v, low, rank() OVER (ORDER BY v)
                    + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS r,
                    (count(*) OVER (PARTITION BY v))::DOUBLE AS t
                  FROM (SELECT delivery_delay_days AS v, review_score <= 2 AS low FROM x_rev
                        WHERE review_score <= 2 OR review_score >= 4)))))"""
BODIES["delivery_kruskal"] = """
  SELECT n, groups, round(h, 5) + 0e0 AS h, round(exp(-h / 2) * (1 + h / 2), 5) + 0e0 AS p_value,
    round((h / 2 - ln(1 + h / 2)) / ln(10e0), 5) + 0e0 AS neg_log10_p
  FROM (SELECT n, groups,
      (12e0 / (n::DOUBLE * (n + 1)) * s - 3e0 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h
    FROM (SELECT sum(c)::BIGINT AS n, count(*) AS groups, sum(r * r / c) AS s, sum(ties) AS ties
      FROM (SELECT count(*) AS c, sum(r) AS r, sum(t * t - 1) AS ties
            FROM (SELECT review_score AS g, rank() OVER (ORDER BY delivery_days)
                    + (count(*) OVER (PARTITION BY delivery_days) - 1) / 2e0 AS r,
                    (count(*) OVER (PARTITION BY delivery_days))::DOUBLE AS t FROM x_rev)
            GROUP BY g)))"""
BODIES["driver_table"] = f"""
  SELECT variable, round(spearman_rho, 8) + 0e0 AS spearman_rho, round(p_value, 8) + 0e0 AS p_value,
    round(neg_log10_p, 5) + 0e0 AS neg_log10_p,
    round("p_value_BH", 8) + 0e0 AS "p_value_BH", "p_value_BH" <= 0.05 AS significant_after_BH,
    round(spearman_rho * spearman_rho, 8) + 0e0 AS "R2"
  FROM ({DRIVERS})"""
BODIES["driver_ranking"] = f"""
  SELECT (row_number() OVER (ORDER BY round(abs(spearman_rho), 12) DESC, variable))::INTEGER AS place,
    variable, round(spearman_rho, 8) + 0e0 AS spearman_rho,
    round("p_value_BH", 8) + 0e0 AS "p_value_BH",
    CASE variable WHEN 'delivery_days' THEN 'time' WHEN 'delivery_delay_days' THEN 'delay'
      WHEN 'n_items' THEN 'size' ELSE '' END AS evidence
  FROM ({DRIVERS}) ORDER BY round(abs(spearman_rho), 12) DESC, variable LIMIT 3"""
BODIES["driver_actions"] = f"""
  SELECT place || '. ' || variable AS factor, round(spearman_rho, 8) + 0e0 AS spearman_rho,
    interpretation, action
  FROM (SELECT *, row_number() OVER (ORDER BY round(abs(spearman_rho), 12) DESC, variable) AS place
        FROM ({DRIVERS}))
    JOIN (VALUES
      (1, 'first', 'step one'), (2, 'second', 'step two'), (3, 'third', 'step three')) a(place, interpretation, action)
      USING (place)"""
BODIES["driver_effects"] = f"""
  SELECT feature AS driver, round_even((rho * 1e4)::DOUBLE, 0) / 1e4 AS rho,
    round_even((rho * rho * 1e4)::DOUBLE, 0) / 1e4 AS "R2", round(p_value, 8) + 0e0 AS p_value,
    round(neg_log10_p, 5) + 0e0 AS neg_log10_p,
    CASE WHEN abs(rho) < 0.1 THEN 'Small' WHEN abs(rho) < 0.3 THEN 'Moderate' ELSE 'Large' END
      AS effect_size,
    CASE WHEN p_value < 0.001 THEN 'Yes' ELSE 'No' END AS significant
  FROM ({_rhos(FEATURES[:7])}) ORDER BY round(abs(rho), 12) DESC, feature LIMIT 3"""
BODIES["delay_ci_by_score"] = """
  SELECT review_score, n, round(m, 8) + 0e0 AS mean, round(e, 8) + 0e0 AS sem,
    round(m - e * 1.96e0, 8) + 0e0 AS ci_low, round(m + e * 1.96e0, 8) + 0e0 AS ci_high
  FROM (SELECT review_score, count(delivery_delay_days) AS n, avg(delivery_delay_days) AS m,
          stddev_samp(delivery_delay_days) / sqrt(count(delivery_delay_days)) AS e
        FROM x_rev GROUP BY review_score)"""
BODIES["medians_by_score"] = """
  SELECT review_score, round(quantile_cont(n_items::DOUBLE, 0.5), 6) + 0e0 AS median_n_items,
    round(quantile_cont(freight_ratio, 0.5), 6) + 0e0 AS median_freight_ratio
  FROM x_rev GROUP BY review_score"""
BODIES["mean_days_by_score"] = """
  SELECT review_score, round_even((avg(delivery_days) * 1e1)::DOUBLE, 0) / 1e1 AS mean_delivery_days
  FROM x_rev GROUP BY review_score"""
for _name, _value in {
    "delay_box_by_score": "delivery_delay_days",
    "items_box_by_score": "n_items",
    "freight_box_by_score": "freight_ratio",
    "days_box_by_score": "delivery_days",
}.items():
    BODIES[_name] = _box(_value, "review_score", "x_rev")
BODIES["late_vs_ontime"] = """
  SELECT round(a * 100, 8) + 0e0 AS pct_negative_late, round(b * 100, 8) + 0e0 AS pct_negative_ontime,
    round(a / b, 8) + 0e0 AS multiplier
  FROM (SELECT avg(is_negative_review) FILTER (delivery_delay_days > 0) AS a,
          avg(is_negative_review) FILTER (delivery_delay_days <= 0) AS b FROM x_rev)"""
BODIES["category_negative_rates"] = CATEGORY_RATES
BODIES["category_rate_extremes"] = f"""
  SELECT * FROM (SELECT 'highest' AS side, * FROM ({CATEGORY_RATES})
    ORDER BY neg_review_rate DESC, category_en LIMIT 10)
  UNION ALL
  SELECT * FROM (SELECT 'lowest' AS side, * FROM ({CATEGORY_RATES})
    ORDER BY neg_review_rate, category_en DESC LIMIT 10)"""
BODIES["state_negative_top10"] = """
  SELECT customer_state, round(avg(is_negative_review), 8) + 0e0 AS neg_review_rate FROM x_rev
  GROUP BY customer_state ORDER BY avg(is_negative_review) DESC, customer_state LIMIT 10"""
BODIES["median_delay_top8"] = """
  SELECT category_en, quantile_cont(delivery_delay_days::DOUBLE, 0.5) AS median_delay
  FROM x_master
  WHERE category_en IN (SELECT category_en FROM x_master WHERE category_en IS NOT NULL
    GROUP BY category_en ORDER BY count(*) DESC, category_en LIMIT 8)
  GROUP BY category_en"""
BODIES["delay_histogram"] = _bins(
    "SELECT least(greatest(delivery_delay_days, a), b)::DOUBLE AS v FROM x_master, "
    "(SELECT quantile_cont(delivery_delay_days::DOUBLE, 0.01) AS a, "
    "quantile_cont(delivery_delay_days::DOUBLE, 0.99) AS b FROM x_master)",
    6,
)
for _name, _n in (("delay_sample", 5000), ("delay_sample_500", 500)):
    BODIES[_name] = f"""
  SELECT order_id, delivery_delay_days, delivery_days, review_score FROM x_rev
  ORDER BY ((order_id + 42) * 48271) % 2147483647, order_id LIMIT {_n}"""

BODIES["base_summary"] = """
  SELECT count(*) AS n_orders, count(DISTINCT customer_unique_id) AS n_customers,
    min(order_purchase_timestamp)::DATE AS first_order,
    max(order_purchase_timestamp)::DATE AS last_order,
    (max(order_purchase_timestamp) + INTERVAL 1 DAY)::DATE AS snapshot FROM x_master"""
BODIES["rfm_metrics"] = "SELECT customer_unique_id, frequency, monetary, recency FROM x_metrics"
BODIES["rfm_describe"] = _describe(
    "x_metrics", ["recency", "frequency", "monetary"], (0.25, 0.5, 0.75), 1
)
BODIES["spend_rank"] = """
  SELECT customer_unique_id, monetary,
    row_number() OVER (ORDER BY monetary, customer_unique_id) AS spend_rank,
    count(*) OVER () AS n_customers FROM x_metrics"""
BODIES["rfm_table"] = f"SELECT {RFM_COLUMNS} FROM x_rfm"
BODIES["rfm_first_rows"] = f"SELECT {RFM_COLUMNS} FROM x_rfm ORDER BY customer_unique_id LIMIT 5"
BODIES["frequency_distribution"] = (
    "SELECT frequency, count(*) AS n FROM x_metrics GROUP BY frequency"
)
BODIES["frequency_score_share"] = """
  SELECT "F_score", count(*) AS n,
    round(count(*) * 100e0 / (SELECT count(*) FROM x_rfm), 8) + 0e0 AS pct FROM x_rfm GROUP BY 1"""
BODIES["segment_counts"] = """
  SELECT segment, count(*) AS n,
    round(count(*) * 100e0 / (SELECT count(*) FROM x_rfm), 8) + 0e0 AS pct FROM x_rfm GROUP BY 1"""
BODIES["segment_summary"] = """
  SELECT segment, n AS n_customers,
    round_even((n / n_all::DOUBLE * 100 * 1e1)::DOUBLE, 0) / 1e1 AS pct_customers,
    round_even(r::DOUBLE, 0) AS avg_recency_days, round_even((f * 1e2)::DOUBLE, 0) / 1e2 AS avg_frequency,
    round_even((c / n::DOUBLE / 100e0 * 1e1)::DOUBLE, 0) / 1e1 AS avg_monetary,
    round_even((c / 100e0)::DOUBLE, 0) AS total_revenue,
    round_even((c / c_all::DOUBLE * 100 * 1e1)::DOUBLE, 0) / 1e1 AS pct_revenue
  FROM (SELECT segment, count(*) AS n, avg(recency) AS r, avg(frequency) AS f,
          sum(cents)::BIGINT AS c, (SELECT count(*) FROM x_rfm) AS n_all,
          (SELECT sum(cents)::BIGINT FROM x_rfm) AS c_all
        FROM x_rfm GROUP BY segment)"""
BODIES["segment_scores"] = """
  SELECT segment, round_even((avg("R_score") * 1e2)::DOUBLE, 0) / 1e2 AS "R_score",
    round_even((avg("F_score") * 1e2)::DOUBLE, 0) / 1e2 AS "F_score",
    round_even((avg("M_score") * 1e2)::DOUBLE, 0) / 1e2 AS "M_score"
  FROM x_rfm GROUP BY segment"""
BODIES["m_by_f"] = """
  SELECT "F_score", round_even((avg("M_score") * 1e3)::DOUBLE, 0) / 1e3 AS mean,
    round_even((stddev_samp("M_score") * 1e3)::DOUBLE, 0) / 1e3 AS std, count("M_score") AS count
  FROM x_rfm GROUP BY "F_score" """
for _name, _n in (("stratified_sample", 600), ("stratified_sample_100", 100)):
    BODIES[_name] = f"""
  SELECT {RFM_COLUMNS}, round(least(monetary, (SELECT quantile_cont(monetary, 0.95) FROM x_rfm)), 4)
      + 0e0 AS monetary_clipped
  FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY {SCATTER}, customer_unique_id) AS i
        FROM x_rfm)
  WHERE i <= {_n}"""
BODIES["clipped_monetary"] = f"""
  SELECT {RFM_COLUMNS}, round(least(monetary, (SELECT quantile_cont(monetary, 0.95) FROM x_rfm
      WHERE segment <> 'Others')), 4) + 0e0 AS monetary_clipped
  FROM x_rfm WHERE segment <> 'Others'"""
_named = """(SELECT segment, recency, least(monetary, (SELECT quantile_cont(monetary, 0.95)
    FROM x_rfm WHERE segment <> 'Others')) AS monetary_clipped FROM x_rfm WHERE segment <> 'Others')"""
BODIES["recency_box_by_segment"] = _box("recency", "segment", _named, 6)
BODIES["spend_box_by_segment"] = _box("monetary_clipped", "segment", _named, 6)
BODIES["segment_actions"] = """
  SELECT a.segment, coalesce(n, 0) AS n_customers, action
  FROM (VALUES
      ('Champions', 'action 1'), ('Loyal', 'action 2'), ('New Customers', 'action 3'),
      ('At Risk', 'action 4'), ('Lost', 'action 5'), ('Others', 'action 6')) a(segment, action)
    LEFT JOIN (SELECT segment, count(*) AS n FROM x_rfm GROUP BY 1) USING (segment)"""

BODIES["order_sequence"] = "SELECT * FROM x_sequence"
BODIES["returning_customers"] = """
  SELECT customer_unique_id, max(total_orders) AS total_orders,
    min(order_purchase_timestamp) AS first_purchase_date,
    max(order_purchase_timestamp) AS last_purchase_date,
    trunc(date_diff('second', min(order_purchase_timestamp), max(order_purchase_timestamp))
      / 86400e0)::INTEGER AS days_between_first_last
  FROM x_sequence GROUP BY customer_unique_id HAVING count(order_id) > 1"""
BODIES["first_orders_with_category"] = "SELECT * FROM x_first_category"
BODIES["retention_ranking"] = "SELECT * FROM x_retention"
BODIES["retention_script"] = "SELECT * FROM x_retention"
BODIES["first_vs_repeat"] = """
  SELECT purchase_rank, CASE purchase_rank WHEN 1 THEN 'First purchase' WHEN 2 THEN 'Second purchase'
      ELSE 'Third purchase or more' END AS purchase_type,
    count(DISTINCT order_id) AS num_orders,
    floor(sum(round(price_total * 100)::BIGINT)::BIGINT / count(*)::DOUBLE / 100e0 * 1e2 + 5e-1) / 1e2
      AS avg_order_value,
    floor(avg(n_items) * 1e2 + 5e-1) / 1e2 AS avg_items_per_order
  FROM x_sequence JOIN x_items_min USING (order_id) GROUP BY 1, 2"""
BODIES["global_retention"] = """
  SELECT count(*) AS total_customers, count(*) FILTER (t > 1) AS retained_customers,
    floor(count(*) FILTER (t > 1) * 100e0 / count(*) * 1e2 + 5e-1) / 1e2
      AS global_retention_rate_pct,
    floor(avg(t) * 1e2 + 5e-1) / 1e2 AS avg_orders_per_customer,
    max(t) AS max_orders_single_customer
  FROM (SELECT customer_unique_id, count(*) AS t FROM x_sequence GROUP BY 1)"""
BODIES["retention_rates"] = """
  SELECT scope, retained, customers, round(retained * 100e0 / customers, 8) + 0e0 AS retention_pct
  FROM (SELECT 'ranked categories' AS scope, sum(retained_customers)::BIGINT AS retained,
          sum(total_customers)::BIGINT AS customers FROM x_retention
        UNION ALL
        SELECT 'all customers', count(*) FILTER (frequency > 1), count(*) FROM x_rfm)"""
_ci = "round(ci95_lo, 8) + 0e0 AS ci95_lo, round(ci95_hi, 8) + 0e0 AS ci95_hi"
BODIES["retention_wilson"] = f"""
  SELECT retention_rank, category, total_customers, retained_customers, churned_customers,
    retention_pct, avg_orders_returning, retention_quartile, volume_rank, {_ci} FROM x_ci"""
BODIES["retention_robust_extremes"] = f"""
  SELECT side, category, total_customers, retention_pct, {_ci} FROM (
    SELECT * FROM (SELECT 'highest' AS side, * FROM x_ci ORDER BY ci95_lo DESC, category LIMIT 3)
    UNION ALL
    SELECT * FROM (SELECT 'lowest' AS side, * FROM x_ci ORDER BY ci95_lo, category DESC LIMIT 3))"""
BODIES["retention_point_extremes"] = f"""
  SELECT "group", category, total_customers, retained_customers, retention_pct,
    avg_orders_returning, {_ci} FROM ({POINT_EXTREMES})"""

BODIES["input_overview"] = """
  SELECT 'master' AS input, count(*) AS rows, 20::INTEGER AS columns FROM x_master
  UNION ALL SELECT 'master_reviewed', count(*), 20::INTEGER FROM x_rev
  UNION ALL SELECT 'rfm', count(*), 10::INTEGER FROM x_rfm
  UNION ALL SELECT 'retention', count(*), 9::INTEGER FROM x_retention"""
BODIES["segment_profile"] = """
  SELECT segment, n_customers, round(n_customers / n_all::DOUBLE * 100, 6) + 0e0 AS pct_customers,
    round(avg_recency, 6) + 0e0 AS avg_recency, round(med_recency, 6) + 0e0 AS med_recency,
    round(avg_frequency, 6) + 0e0 AS avg_frequency,
    round(c / n_customers::DOUBLE / 100, 6) + 0e0 AS avg_monetary,
    round(med_monetary, 6) + 0e0 AS med_monetary, round(c / 100e0, 6) + 0e0 AS total_revenue,
    round(c / c_all::DOUBLE * 100, 6) + 0e0 AS pct_revenue, round(r, 6) + 0e0 AS "avg_R",
    round(f, 6) + 0e0 AS "avg_F", round(m, 6) + 0e0 AS "avg_M",
    round(s, 6) + 0e0 AS "avg_RFM_score",
    CASE segment WHEN 'Champions' THEN 'A' WHEN 'Loyal' THEN 'B' WHEN 'New Customers' THEN 'C'
      WHEN 'At Risk' THEN 'D' WHEN 'Lost' THEN 'E' ELSE '' END AS profile
  FROM (SELECT segment, count(*) AS n_customers, avg(recency) AS avg_recency,
          quantile_cont(recency::DOUBLE, 0.5) AS med_recency, avg(frequency) AS avg_frequency,
          quantile_cont(monetary, 0.5) AS med_monetary, sum(cents)::BIGINT AS c,
          avg("R_score") AS r, avg("F_score") AS f, avg("M_score") AS m, avg("RFM_score") AS s,
          (SELECT count(*) FROM x_rfm) AS n_all, (SELECT sum(cents)::BIGINT FROM x_rfm) AS c_all
        FROM x_rfm GROUP BY segment)"""


def _check(label, value, a, b):
    return f"""SELECT '{label}' AS "check", (SELECT avg({value}) FROM x_rfm WHERE segment = '{a}')
      > (SELECT avg({value}) FROM x_rfm WHERE segment = '{b}') AS passed"""


BODIES["segment_checks"] = " UNION ALL ".join(
    [
        _check("Champions spend more than Lost", "cents", "Champions", "Lost"),
        _check("Loyal spend more than New Customers", "cents", "Loyal", "New Customers"),
        _check("At Risk order more often than Lost", "frequency", "At Risk", "Lost"),
        _check(
            "Champions order more often than New Customers", "frequency", "Champions", "New Customers"
        ),
    ]
)
BODIES["satisfaction_by_segment"] = f"""
  SELECT segment, n_orders, round(neg_review_rate, 8) + 0e0 AS neg_review_rate,
    round(avg_score, 8) + 0e0 AS avg_score, round(avg_delay, 8) + 0e0 AS avg_delay
  FROM ({SATISFACTION})"""
BODIES["executive_summary"] = f"""
  SELECT panel, label, round(value, 8) + 0e0 AS value FROM (
    SELECT 'A' AS panel, segment AS label, count(*) * 100e0 / (SELECT count(*) FROM x_rfm) AS value
      FROM x_rfm WHERE segment <> 'Others' GROUP BY segment
    UNION ALL SELECT 'B', feature, abs(rho) FROM (SELECT * FROM ({_rhos(FEATURES[:7])})
      ORDER BY round(abs(rho), 12) DESC, feature LIMIT 3)
    UNION ALL SELECT 'C', "group" || ': ' || category, retention_pct FROM ({POINT_EXTREMES})
    UNION ALL SELECT 'D', segment, neg_review_rate * 100 FROM ({SATISFACTION})
      WHERE segment <> 'Others')"""


def statement(body):
    """The body with the definitions it needs, in their order of declaration."""
    needed, open_names = set(), set(re.findall(r"\bx_\w+", body))
    while open_names:
        name = open_names.pop()
        needed.add(name)
        open_names |= set(re.findall(r"\bx_\w+", VIEWS[name])) - needed
    defined = ",\n".join(f"{n} AS ({v})" for n, v in VIEWS.items() if n in needed)
    return f"WITH {defined}\n{body}" if defined else body


# --- total orders: the position that each row must have -----------------------------------

_by_label = "CASE {0} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(
    ("Champions", "Loyal", "New Customers", "At Risk", "Lost", "Others"))) + " ELSE 6 END"
for _name, _body, _keys in (
    ("master_sql_ordered", "SELECT order_id, order_purchase_timestamp, customer_unique_id, price_total "
        "FROM x_master_sql", "order_purchase_timestamp, order_id"),
    ("retention_ranking_ordered", BODIES["retention_ranking"], "retention_rank, category"),
    ("segment_summary_ordered", BODIES["segment_summary"], _by_label.format("segment") + ", segment"),
    ("satisfaction_ordered", BODIES["satisfaction_by_segment"], _by_label.format("segment") + ", segment"),
    ("executive_summary_ordered", BODIES["executive_summary"],
        f"panel, {_by_label.format('label')}, value DESC, label"),
):
    BODIES[_name] = f"SELECT *, row_number() OVER (ORDER BY {_keys}) AS position FROM ({_body})"
