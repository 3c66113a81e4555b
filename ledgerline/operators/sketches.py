"""Distinct customers of any range of days from daily sketches, without reading the orders again.

A day's row holds a HyperLogLog sketch of its customers.  Sketches of days
merge into weeks, months or any other range, and a sketch of the newest day
can be replaced alone; distinct counts themselves can't be added up.  The
relative standard error is 1.04 / sqrt(2^``LG_K``), 1.6 %, at any size: a
sketch is a few kilobytes however many customers a day has, and is combined
map-side.

Orders without a date or customer are left out; a range without orders has
no customers (0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lit_date
from ..sources.partitions import PART, month_of, read_partitions, replace_partitions, touched

LG_K = 12
RELATIVE_ERROR = 1.04 / math.sqrt(1 << LG_K)
SKETCHES = "order_day date, orders bigint, customers binary"


def daily_sketches(orders: DataFrame) -> DataFrame:
    """order_day, orders and the sketch ``customers`` of each day."""
    known = orders.where("order_date IS NOT NULL AND customer_id IS NOT NULL")
    return known.groupBy(F.to_date("order_date").alias("order_day")).agg(
        F.count(F.lit(1)).alias("orders"), F.hll_sketch_agg("customer_id", LG_K).alias("customers"))


def merged_customers(sketches: DataFrame, *by: Column) -> DataFrame:
    """Distinct customers (estimated) and orders per group of days."""
    return sketches.groupBy(*by).agg(F.sum("orders").alias("orders"),
                                     F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("customers"))


def customers_between(sketches: DataFrame, first, last) -> DataFrame:
    """One row: orders and distinct customers (estimated) of the days ``first`` to ``last``."""
    day = F.col("order_day")
    return merged_customers(sketches.where((day >= lit_date(first)) & (day <= lit_date(last)))).select(
        F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("customers", F.lit(0)).alias("customers"))


def store_sketches(spark: SparkSession, path: str, orders: DataFrame, months: list[str] | None = None) -> list[str]:
    """Write the sketches of the orders' months (or of ``months`` among them); other months stay. Returns the months written."""
    orders = orders.where("order_date IS NOT NULL")
    months = touched(orders, month_of("order_date")) if months is None else months
    rows = daily_sketches(orders.where(month_of("order_date").isin(months)))
    root, name = path.rstrip("/").rsplit("/", 1)
    replace_partitions(root, {name: (rows.withColumn(PART, month_of("order_day")), months)})
    return months


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return read_partitions(spark, path, SKETCHES)
