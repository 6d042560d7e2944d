"""Every query beside its SQL, on the small tables and on tables with hot keys."""

import duckdb
import pytest

from checks import catalog, compare, oracle
from tests.conftest import SMALL

import __spark_entry__ as entry_module

HOT = [
    "items_per_order",
    "latest_review",
    "main_item",
    "master_notebook",
    "order_sequence",
    "first_vs_repeat",
    "first_orders_with_category",
    "rfm_table",
    "stratified_sample",
    "spearman_scores",
    "delay_box_by_score",
    "payment_describe",
    "satisfaction_by_segment",
    "executive_summary",
    "stratified_sample_100",
    "delay_sample_500",
    "master_sql_ordered",
    "eda_pearson",
    "quality_all_tables",
]


@pytest.fixture(scope="module")
def con():
    return compare.duck(SMALL)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """One order, one product and one customer hold a third of the rows each."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    db = duckdb.connect()
    changes = {
        "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey",
        "lineitem": "CASE WHEN l_suppkey % 3 = 0 THEN 502 ELSE l_orderkey END AS l_orderkey, "
        "CASE WHEN l_suppkey % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey, "
        "CASE WHEN l_linenumber = 2 THEN 1000.0 ELSE l_extendedprice END AS l_extendedprice",
    }
    for t in compare.TABLES:
        change = f"REPLACE ({changes[t]})" if t in changes else ""
        db.execute(
            f"COPY (SELECT * {change} FROM '{SMALL}/{t}.parquet') TO '{folder}/{t}.parquet' "
            "(FORMAT parquet)"
        )
    return folder


def test_every_query_has_sql():
    assert set(oracle.BODIES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert all(oracle.statement(b) for b in oracle.BODIES.values())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(name, spark, con, SMALL) is None


@pytest.mark.parametrize("name", HOT)
def test_hot_keys(spark, skewed, name):
    assert compare.difference(name, spark, compare.duck(skewed), skewed) is None


def test_comparison_notices_a_wrong_value(spark, con, monkeypatch):
    body = "SELECT * REPLACE (order_id + (order_id = 502)::INTEGER AS order_id) FROM x_items_min"
    monkeypatch.setitem(oracle.BODIES, "items_per_order", body)
    assert "of" in compare.difference("items_per_order", spark, con, SMALL)
