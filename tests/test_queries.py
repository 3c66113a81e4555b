"""Every registered query against its DuckDB twin (small scale), plus Q1's brute force."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare, duck

from ledgerline.plans.oracle_sql import ORACLE
from ledgerline.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert info["ok"], info


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 25


def _order_detail(t, limit=500):
    from brute import order_detail

    from ledgerline.functions import add_months_sticky
    from ledgerline.sources.fixtures import AS_OF
    return order_detail(t, *[add_months_sticky(AS_OF, -m) for m in (24, 1, 6)], limit)


def test_q1_factorized_equals_bruteforce_at_sf001(spark):
    from ledgerline.plans.analytics import customer_order_detail
    from ledgerline.sources import load_tables
    t = load_tables(spark, "/root/testdata/sf0.01")
    a = [tuple(r) for r in customer_order_detail(t).collect()]
    b = _order_detail(t)
    assert a == b


def test_q1_with_a_hot_customer(spark):
    """Skew: one customer owns a third of all orders; limits small and large."""
    from pyspark.sql import functions as F

    from ledgerline.plans.analytics import customer_order_detail
    from ledgerline.sources import load_tables
    t = load_tables(spark, SF_SMALL)
    o = t["orders"]
    hot = o.withColumn("customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(1)).otherwise(F.col("customer_id")))
    t2 = {k: t[k] for k in ["customers", "order_items", "products", "inventory", "transactions"]}
    t2["orders"] = hot
    for limit in (5, 500, 5000):
        a = [tuple(r) for r in customer_order_detail(t2, limit=limit).collect()]
        b = _order_detail(t2, limit)
        assert a == b, limit


@pytest.mark.parametrize("name", ["daily_sales", "executive_dashboard", "customer_retention", "merge_sales_summary",
                                  "aggregate_products"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        info = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert info["ok"], info


def test_q1_when_most_orders_lack_items(spark):
    """Orders without a line give no row, so the boundary must lie beyond many of them."""
    from pyspark.sql import functions as F

    from ledgerline.plans.analytics import customer_order_detail
    from ledgerline.sources import load_tables
    t = load_tables(spark, SF_SMALL)
    t2 = {k: t[k] for k in ["customers", "orders", "products", "inventory", "transactions"]}
    t2["order_items"] = t["order_items"].where(F.col("order_id") % 97 == 0)
    for limit in (20, 60):
        a = [tuple(r) for r in customer_order_detail(t2, limit=limit).collect()]
        b = _order_detail(t2, limit)
        assert a == b and len(a) > 0, limit


def test_q1_empty_window(spark):
    from ledgerline.plans.analytics import customer_order_detail
    from ledgerline.sources import load_tables
    df = customer_order_detail(load_tables(spark, SF_SMALL), as_of="2100-01-01 00:00:00", months=1)
    assert df.count() == 0 and len(df.columns) == 25
