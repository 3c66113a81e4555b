"""Rollups merged into the analytics tables: Q7 (SALES_SUMMARY) and the two
``aggregate-*`` jobs (CUSTOMER_ANALYTICS, PRODUCT_PERFORMANCE).

Each is a per-key aggregate (map-side combined) followed by :func:`upsert`.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_timestamp, day_start, lit_date, lit_ts
from ..operators.upsert import upsert
from ..schema import SCHEMAS
from ..session import scratch_dir
from ..sources.fixtures import AS_OF
from ..sources.partitions import merge_partitions, month_of, read_partitions

# Statuses counted by the rollup; spend cut-offs of the value segment.
ROLLUP_STATUSES = ("COMPLETED", "SHIPPED", "DELIVERED")
SEGMENT_HIGH, SEGMENT_MEDIUM = 1000, 500


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    """An empty table with the DDL schema, built JVM-side (no Python-side rows)."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def div_half_up(num: Column, den: Column, scale: int = 2) -> Column:
    """num/den rounded half away from zero to ``scale`` digits, exactly.

    The quotient floor((2|n| + |d|) / 2|d|) is taken from a decimal division
    and corrected by one step where exact multiplication shows it is off, so
    no intermediate rounding can leak into the result.  NULL when den is 0.
    """
    n = num * F.lit(10 ** scale)
    a = F.abs(n) * 2 + F.abs(den)
    b = F.abs(den) * 2
    q0 = F.floor(a / b)
    q = F.when((q0 + 1) * b <= a, q0 + 1).when(q0 * b > a, q0 - 1).otherwise(q0)
    signed = F.when((n < 0) != (den < 0), -q).otherwise(q)
    unit = F.lit(f"1E-{scale}").cast(f"decimal({scale + 1},{scale})")
    return F.when(den != 0, signed.cast("decimal(38,0)") * unit)


# --------------------------------------------------------------------------- Q7
def sales_rollup(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    """Per day since midnight ``days`` days ago: orders and revenue of shipped-or-done orders."""
    lo = day_start(as_of) - _dt.timedelta(days=days)
    o = t["orders"].where((F.col("order_date") >= lit_ts(lo)) & F.col("status").isin(list(ROLLUP_STATUSES)))
    return (o.groupBy(F.to_date("order_date").alias("summary_date"))
            .agg(F.count(F.lit(1)).alias("total_orders"), F.sum("total_amount").alias("total_revenue")))


def merge_sales_summary(t, target: DataFrame, as_of=AS_OF, days: int = 7) -> DataFrame:
    """MERGE the rollup into SALES_SUMMARY: matched days get new totals, new days new ids."""
    src = sales_rollup(t, as_of, days)
    # the source is grouped by the merge key, so it is unique by construction
    return upsert(target, src, ["summary_date"], ["total_orders", "total_revenue"], id_col="summary_id",
                  table="sales_summary", as_of=as_of, check_unique=False)


def merge_sales_summary_twice(t, as_of=AS_OF, days: int = 7, earlier_days: int = 3) -> DataFrame:
    """The registered check: yesterday's-style run ``earlier_days`` before, then today's merge."""
    spark = t["orders"].sparkSession
    first = merge_sales_summary(t, empty_table(spark, "sales_summary"),
                                as_timestamp(as_of) - _dt.timedelta(days=earlier_days), days)
    # the first run's result stands on written copies: the second reads them
    return merge_sales_summary(t, first, as_of, days)


def merge_stored_summary(spark: SparkSession, path: str, t, as_of=AS_OF, days: int = 7) -> DataFrame:
    """The rollup as a stored job: only the months it touches are read, merged and written; returns the change feed."""
    return merge_partitions(spark, path, "sales_summary", sales_rollup(t, as_of, days), month_of, "summary_date", ["summary_date"],
                            ["total_orders", "total_revenue"], "summary_id", as_of, check_unique=False)


def stored_sales_summary(t, as_of=AS_OF, days: int = 7, earlier_days: int = 3) -> DataFrame:
    """The registered check of the stored job: two runs over one stored table, with each run's changed rows."""
    spark = t["orders"].sparkSession
    path = scratch_dir(spark, "sales-summary")
    runs = [as_timestamp(as_of) - _dt.timedelta(days=earlier_days), as_of]
    n = [merge_stored_summary(spark, path, t, at, days).count() for at in runs]
    return read_partitions(spark, path, SCHEMAS["sales_summary"]).select(
        "summary_id", "summary_date", "total_orders", "total_revenue", F.lit(n[0]).cast("bigint").alias("first_run_rows"),
        F.lit(n[1]).cast("bigint").alias("second_run_rows"))


def merge_changes(t, as_of=AS_OF, days: int = 7, earlier_days: int = 3) -> DataFrame:
    """The change feed of a stored run: an earlier run knew the orders of its own day, today's updates and adds to it."""
    spark = t["orders"].sparkSession
    path = scratch_dir(spark, "sales-summary")
    early = as_timestamp(as_of) - _dt.timedelta(days=earlier_days)
    merge_stored_summary(spark, path, {"orders": t["orders"].where(F.col("order_date") < lit_ts(early))}, early, days)
    return merge_stored_summary(spark, path, t, as_of, days).select(
        "operation", "new.summary_id", "new.summary_date", F.col("old.total_orders").alias("old_orders"),
        F.col("new.total_orders").alias("new_orders"), F.col("old.total_revenue").alias("old_revenue"),
        F.col("new.total_revenue").alias("new_revenue"))


# ----------------------------------------------------------- aggregate-customers
def customer_stats(t, as_of=AS_OF) -> DataFrame:
    """Per customer, all orders up to ``as_of``: count, spend, average, last order, segment."""
    o = t["orders"].where(F.col("order_date") <= lit_ts(as_of))
    agg = o.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_orders"),
                                       F.sum("total_amount").alias("_spent"),
                                       F.count("total_amount").alias("_priced"),
                                       F.max("order_date").alias("last_order_date"))
    spent = F.col("_spent")
    return agg.select(
        "customer_id", "total_orders", spent.cast("decimal(12,2)").alias("total_spent"),
        div_half_up(spent, F.col("_priced")).cast("decimal(10,2)").alias("avg_order_value"),
        "last_order_date",
        F.when(spent >= SEGMENT_HIGH, "HIGH_VALUE").when(spent >= SEGMENT_MEDIUM, "MEDIUM_VALUE")
        .otherwise("LOW_VALUE").alias("customer_segment"),
        lit_ts(as_of).alias("calculated_at"))


def aggregate_customers(t, target: DataFrame, as_of=AS_OF) -> DataFrame:
    """aggregate-customers: merge per-customer stats into CUSTOMER_ANALYTICS (update matched, insert new with ids)."""
    src = customer_stats(t, as_of)
    cols = ["total_orders", "total_spent", "avg_order_value", "last_order_date", "customer_segment",
            "calculated_at"]
    return upsert(target, src, ["customer_id"], cols, id_col="analytics_id", table="customer_analytics",
                  as_of=as_of, check_unique=False)


def aggregate_customers_twice(t, as_of=AS_OF, earlier_days: int = 30) -> DataFrame:
    """The registered check: an earlier run into an empty table, then the run at ``as_of`` merged over it."""
    spark = t["orders"].sparkSession
    first = aggregate_customers(t, empty_table(spark, "customer_analytics"),
                                as_timestamp(as_of) - _dt.timedelta(days=earlier_days))
    return aggregate_customers(t, first, as_of)


# ------------------------------------------------------------ aggregate-products
def product_stats(t, period_start, period_end, as_of=AS_OF, data_until=None) -> DataFrame:
    """Per product over orders dated in [period_start, period_end + 1 day):
    units, revenue, profit (revenue - units x cost) and returned lines."""
    ps, pe = day_start(period_start), day_start(period_end)
    hi = pe + _dt.timedelta(days=1)
    if data_until is not None:
        hi = min(hi, as_timestamp(data_until))
    o = t["orders"].where((F.col("order_date") >= lit_ts(ps)) & (F.col("order_date") < lit_ts(hi))) \
        .select("order_id", "status")
    i = t["order_items"].select("order_id", "product_id", "quantity", "subtotal").join(o, "order_id")
    per = i.groupBy("product_id").agg(F.sum("quantity").alias("units_sold"), F.sum("subtotal").alias("_rev"),
                                      F.count_if(F.col("status") == "RETURNED").alias("return_count"))
    p = t["products"].select("product_id", "cost")
    return per.join(p, "product_id").select(
        "product_id", lit_date(ps).alias("period_start"), lit_date(pe).alias("period_end"),
        F.col("units_sold").cast("bigint").alias("units_sold"), F.col("_rev").cast("decimal(12,2)").alias("revenue"),
        (F.col("_rev") - F.col("units_sold") * F.col("cost")).cast("decimal(12,2)").alias("profit"),
        F.col("return_count").cast("bigint").alias("return_count"), lit_ts(as_of).alias("calculated_at"))


def aggregate_products(t, target: DataFrame, as_of=AS_OF, days: int = 90, data_until=None) -> DataFrame:
    """aggregate-products: merge per-product stats of the last ``days`` days into PRODUCT_PERFORMANCE."""
    end = day_start(as_of)
    src = product_stats(t, end - _dt.timedelta(days=days), end, as_of, data_until)
    cols = ["period_end", "units_sold", "revenue", "profit", "return_count", "calculated_at"]
    return upsert(target, src, ["product_id", "period_start"], cols, id_col="performance_id",
                  table="product_performance", as_of=as_of, check_unique=False)


def aggregate_products_twice(t, as_of=AS_OF, days: int = 90, stale_days: int = 30) -> DataFrame:
    """The registered check: a run that saw orders only up to ``stale_days`` before the
    clock, then the full run merged over it (updates plus late-selling products)."""
    spark = t["orders"].sparkSession
    stale = day_start(as_of) - _dt.timedelta(days=stale_days)
    first = aggregate_products(t, empty_table(spark, "product_performance"), as_of, days, data_until=stale)
    return aggregate_products(t, first, as_of, days)
