-- Category retention ranking, for one Spark SQL statement over bound tables.
WITH history AS (
    SELECT
        c.customer_unique_id,
        min(struct(o.order_purchase_timestamp, o.order_id)).order_id AS first_order,
        count(*) AS orders
    FROM {orders} o
    JOIN {customers} c USING (customer_id)
    WHERE o.order_status = 'delivered'
    GROUP BY c.customer_unique_id
),
lead_item AS (
    SELECT order_id, max_by(product_id, struct(price, -order_item_id, product_id)) AS product_id
    FROM {order_items}
    GROUP BY order_id
),
rated AS (
    SELECT
        coalesce(t.product_category_name_english, 'unknown') AS category,
        count(*) AS total_customers,
        count_if(h.orders > 1) AS retained_customers,
        floor(count_if(h.orders > 1) * 100D / count(*) * 100D + 0.5D) / 100D AS retention_pct,
        floor(avg(CASE WHEN h.orders > 1 THEN h.orders END) * 100D + 0.5D) / 100D
            AS avg_orders_returning
    FROM history h
    JOIN lead_item i ON i.order_id = h.first_order
    LEFT JOIN {products} p ON p.product_id = i.product_id
    LEFT JOIN {category_translation} t ON t.product_category_name = p.product_category_name
    GROUP BY coalesce(t.product_category_name_english, 'unknown')
    HAVING count(*) >= {min_customers}
)
SELECT
    rank() OVER (ORDER BY retention_pct DESC) AS retention_rank,
    category,
    total_customers,
    retained_customers,
    total_customers - retained_customers AS churned_customers,
    retention_pct,
    avg_orders_returning,
    ntile(4) OVER (ORDER BY retention_pct DESC, category) AS retention_quartile,
    rank() OVER (ORDER BY total_customers DESC) AS volume_rank
FROM rated
