"""The nine source tables, derived row by row from the generated star-schema tables.

FIXTURES.md states the rules. They use whole-number arithmetic only, so any engine
builds the same rows, and no step needs a window or a sort.
"""

from collections.abc import Mapping

# columns of the generated tables that the rules read
SCANS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "supplier": "s_suppkey bigint, s_nationkey int",
}

PURCHASE = "timestampadd(MINUTE, o_orderkey % 24 * 60 + o_orderkey % 60, o_orderdate)"
TRANSIT = "o_orderkey * 37 % 960"
ARRIVAL = (
    "case when o_orderstatus = 'F' and o_orderkey % 211 <> 0 "
    f"then timestampadd(HOUR, {TRANSIT}, {PURCHASE}) end"
)
ESTIMATE = "timestampadd(HOUR, (15 + o_orderkey % 11) * 24, o_orderdate)"
CREATED = f"cast(date_add(date(least({ARRIVAL}, {ESTIMATE})), 1) as timestamp_ntz)"
CENTS = "bigint(rint(l_extendedprice * 100))"


class FixtureTables(Mapping):
    """Tables by name; a table is planned when it is first asked for."""

    NAMES = (
        "orders",
        "order_items",
        "order_payments",
        "order_reviews",
        "customers",
        "products",
        "sellers",
        "geolocation",
        "category_translation",
    )

    def __init__(self, spark, folder):
        self._spark, self._folder, self._built = spark, folder, {}

    def __getitem__(self, name):
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = getattr(self, f"_{name}")()
        return self._built[name]

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self):
        return len(self.NAMES)

    def _scan(self, name):
        return self._spark.read.schema(SCANS[name]).parquet(f"{self._folder}/{name}.parquet")

    def _orders(self):
        return self._scan("orders").selectExpr(
            "o_orderkey as order_id",
            "o_custkey as customer_id",
            "case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' "
            "else 'canceled' end as order_status",
            f"{PURCHASE} as order_purchase_timestamp",
            f"case when o_orderkey % 97 <> 0 then timestampadd(HOUR, 1, {PURCHASE}) end "
            "as order_approved_at",
            f"case when o_orderstatus = 'F' then timestampadd(HOUR, ({TRANSIT}) div 2, {PURCHASE}) "
            "end as order_delivered_carrier_date",
            f"{ARRIVAL} as order_delivered_customer_date",
            f"{ESTIMATE} as order_estimated_delivery_date",
        )

    def _order_items(self):
        return self._scan("lineitem").selectExpr(
            "l_orderkey as order_id",
            "l_linenumber as order_item_id",
            "l_partkey as product_id",
            "l_suppkey as seller_id",
            "l_shipdate as shipping_limit_date",
            "l_extendedprice as price",
            f"({CENTS} * bigint(rint(l_tax * 100)) + 50) div 100 / 100D as freight_value",
        )

    def _order_payments(self):
        return self._scan("lineitem").selectExpr(
            "l_orderkey as order_id",
            "l_linenumber as payment_sequential",
            "l_returnflag as payment_type",
            "1 + l_linenumber as payment_installments",
            f"({CENTS} * (100 - bigint(rint(l_discount * 100))) + 50) div 100 / 100D "
            "as payment_value",
        )

    def _order_reviews(self):
        lines = self._scan("lineitem").filter("l_returnflag <> 'N'")
        orders = self._scan("orders").drop("o_custkey")
        both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        both = both.selectExpr("*", f"{CREATED} as created")
        return both.selectExpr(
            "concat_ws('-', 'R', l_orderkey, l_linenumber, l_partkey, l_suppkey, int(l_quantity)) "
            "as review_id",
            "l_orderkey as order_id",
            "int(case when l_quantity > 40 then 1 + int(l_quantity) % 5 "
            f"else 5 - least(4, ({TRANSIT}) div 216) end) as review_score",
            "case when l_partkey % 8 = 0 then 'title' end as review_comment_title",
            "case when l_partkey % 3 <> 0 then 'msg' end as review_comment_message",
            "created as review_creation_date",
            "timestampadd(HOUR, l_partkey % 72, created) as review_answer_timestamp",
        )

    def _with_nation(self, name, key):
        table, nation = self._scan(name), self._scan("nation")
        return table.join(nation, table[key] == nation.n_nationkey)

    def _customers(self):
        return self._with_nation("customer", "c_nationkey").selectExpr(
            "c_custkey as customer_id",
            "case when c_custkey % 10 = 1 then c_custkey - 1 else c_custkey end "
            "as customer_unique_id",
            "c_name as customer_city",
            "n_name as customer_state",
        )

    def _geolocation(self):
        return self._with_nation("customer", "c_nationkey").selectExpr(
            "c_nationkey as zip_prefix",
            "c_nationkey * 1D as lat",
            "c_nationkey * -1D as lng",
            "n_name as state",
        )

    def _sellers(self):
        return self._with_nation("supplier", "s_nationkey").selectExpr(
            "s_suppkey as seller_id", "n_name as seller_state"
        )

    def _products(self):
        return self._scan("part").selectExpr(
            "p_partkey as product_id",
            "case when p_partkey % 53 <> 0 then p_brand end as product_category_name",
            "double(p_size * 100) as product_weight_g",
        )

    def _category_translation(self):
        brands = self._scan("part").select("p_brand").distinct()
        return brands.filter("p_brand not in ('Brand#7', 'Brand#13')").selectExpr(
            "p_brand as product_category_name",
            "lower(replace(p_brand, '#', '_')) as product_category_name_english",
        )


def fixture_tables(spark, folder):
    return FixtureTables(spark, folder)
