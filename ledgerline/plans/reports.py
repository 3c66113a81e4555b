"""The report tier: endpoints the reference names but leaves empty.

Definitions are ours; each is one or two map-side-combined aggregates over
the filtered scan.  Ratios are rounded half up in exact integer arithmetic
(see :func:`div_half_up`).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import add_months_sticky, as_timestamp, lit_ts, month_index, month_label_from_index, order_desc
from ..operators.baskets import frequent_pairs
from ..session import materialize
from ..sources.fixtures import AS_OF
from .warehouse import SEGMENT_HIGH, SEGMENT_MEDIUM, div_half_up

DEC = "decimal(38,2)"


def _since(t, days=None, months=None, as_of=AS_OF):
    lo = (add_months_sticky(as_of, -months) if months is not None
          else as_timestamp(as_of) - _dt.timedelta(days=days))
    return t["orders"].where(F.col("order_date") >= lit_ts(lo))


def _window_items(t, days, as_of, *item_cols):
    o = _since(t, days=days, as_of=as_of).select("order_id")
    return t["order_items"].select("order_id", *item_cols).join(o, "order_id")


# ------------------------------------------------------------------- sales
def top_products(t, as_of=AS_OF, days: int = 30, n: int = 10) -> DataFrame:
    """The ``n`` products with the highest item revenue in the window (a top-k report)."""
    per = _window_items(t, days, as_of, "product_id", "quantity", "subtotal").groupBy("product_id").agg(
        F.sum("quantity").cast("bigint").alias("units_sold"), F.sum("subtotal").cast(DEC).alias("revenue"))
    p = t["products"].select("product_id", "product_name", "category")
    return (per.join(p, "product_id").orderBy(order_desc("revenue"), "product_id").limit(n)
            .select("product_id", "product_name", "category", "units_sold", "revenue"))


def revenue_by_payment(t, as_of=AS_OF, days: int = 30) -> DataFrame:
    """Orders and revenue per payment method in the window."""
    return (_since(t, days=days, as_of=as_of).groupBy("payment_method")
            .agg(F.count(F.lit(1)).alias("total_orders"), F.sum("total_amount").cast(DEC).alias("revenue")))


# ------------------------------------------------------------------- customers
def _customer_spend(t, as_of, months):
    return (_since(t, months=months, as_of=as_of).groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("spend")))


def customer_segmentation(t, as_of=AS_OF, months: int = 12) -> DataFrame:
    """Customers per spend segment (cut-offs of the order-detail value segment)."""
    s = _customer_spend(t, as_of, months)
    seg = (F.when(F.col("spend") >= SEGMENT_HIGH, "HIGH_VALUE").when(F.col("spend") >= SEGMENT_MEDIUM, "MEDIUM_VALUE")
           .otherwise("LOW_VALUE"))
    return s.groupBy(seg.alias("segment")).agg(F.count(F.lit(1)).alias("customers"),
                                              F.sum("orders").cast("bigint").alias("orders"),
                                              F.sum("spend").cast(DEC).alias("spend"))


def customer_ltv(t) -> DataFrame:
    """All-time value per customer: orders, total, average (half up), first and last order."""
    return (t["orders"].groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("_tot"),
                 F.count("total_amount").alias("_nt"),
                 F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))
            .select("customer_id", "orders", F.col("_tot").cast(DEC).alias("lifetime_value"),
                    div_half_up(F.col("_tot"), F.col("_nt")).cast(DEC).alias("avg_order_value"),
                    "first_order", "last_order"))


def purchase_frequency(t) -> DataFrame:
    """Orders per customer and the mean gap in days between consecutive orders.

    The mean of consecutive gaps telescopes to (last - first) / (n - 1), so no
    per-customer window (and no hot partition) is needed.
    """
    agg = t["orders"].groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.min("order_date").alias("_f"), F.max("order_date").alias("_l"))
    span = F.datediff(F.to_date("_l"), F.to_date("_f"))
    return agg.select("customer_id", "orders",
                      div_half_up(span, F.col("orders") - 1).cast(DEC).alias("avg_days_between_orders"))


# ------------------------------------------------------------------- products
def _units_in_window(t, days, as_of):
    return _window_items(t, days, as_of, "product_id", "quantity", "subtotal").groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.sum("subtotal").alias("rev"))


def inventory_turnover(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    """Units sold in the window over stock on hand, per product with stock rows."""
    stock = t["inventory"].groupBy("product_id").agg(F.sum("quantity_available").alias("stock"))
    sold = _units_in_window(t, days, as_of)
    j = stock.join(sold, "product_id", "left")
    units = F.coalesce(F.col("units"), F.lit(0))
    return j.select("product_id", F.col("stock").cast("bigint").alias("stock"), units.cast("bigint").alias("units_sold"),
                    div_half_up(units, F.col("stock"), 4).cast("decimal(38,4)").alias("turnover"))


def slow_moving(t, as_of=AS_OF, days: int = 90, below: int = 5) -> DataFrame:
    """Active products with stock on hand that sold fewer than ``below`` units in the window."""
    stock = t["inventory"].groupBy("product_id").agg(F.sum("quantity_available").alias("stock"))
    sold = _units_in_window(t, days, as_of)
    p = t["products"].where(F.col("is_active") == 1).select("product_id", "product_name")
    units = F.coalesce(F.col("units"), F.lit(0))
    return (p.join(stock, "product_id").join(sold, "product_id", "left")
            .where((F.col("stock") > 0) & (units < below))
            .select("product_id", "product_name", F.col("stock").cast("bigint").alias("stock"),
                    units.cast("bigint").alias("units_sold")))


def profit_margin(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    """Per category, and per product within it: revenue, cost of goods (units x cost), profit and margin %.

    Items are summed per product first (a hot product is one row a task);
    cost and category join the sums.  ``product_id`` is null in the rows of
    whole categories.
    """
    i = _window_items(t, days, as_of, "product_id", "quantity", "subtotal")
    sold = i.groupBy("product_id").agg(F.sum("subtotal").alias("_r"), F.sum("quantity").alias("_q"))
    per = sold.join(t["products"].select("product_id", "category", "cost"), "product_id").select(
        "category", "product_id", "_r", (F.col("_q") * F.col("cost")).alias("_c"))
    both = per.select("category", "_r", "_c", F.explode(F.array(F.col("product_id"), F.lit(None).cast("bigint"))).alias("product_id"))
    sums = both.groupBy("category", "product_id").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    profit = F.col("_r") - F.col("_c")
    return sums.select("category", "product_id", F.col("_r").cast(DEC).alias("revenue"), F.col("_c").cast(DEC).alias("cost"),
                       profit.cast(DEC).alias("profit"),
                       div_half_up(profit * 100, F.col("_r")).cast(DEC).alias("margin_pct"))


def category_leaders(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    """Anchors for :func:`affinity`: of each category, the product in the most orders of the window."""
    n = (_window_items(t, days, as_of, "product_id").distinct().groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
         .join(t["products"].select("product_id", "category"), "product_id"))
    top = n.groupBy("category").agg(F.max(F.struct("n", (-F.col("product_id")).alias("neg"))).alias("top"))
    return top.select((-F.col("top.neg")).alias("anchor_id"))


def affinity(t, anchors: DataFrame | None = None, as_of=AS_OF, days: int = 90) -> DataFrame:
    """Products bought together with each anchor product ("bought X, also bought").

    ``anchors`` holds anchor_id values (default: :func:`category_leaders`).
    The window's distinct (order, product) rows are written once; the orders
    of the anchors meet them in one join, and only pairs with an anchor are
    counted.  Per anchor and product: orders together, the product's orders,
    support within the anchor's orders (%) and lift.
    """
    items = materialize(_window_items(t, days, as_of, "product_id").distinct(), "affinity-items")
    anchors = (category_leaders(t, as_of, days) if anchors is None else anchors).select("anchor_id").distinct()
    per_prod = items.groupBy("product_id").agg(F.count(F.lit(1)).alias("orders"))
    n_orders = items.agg(F.count_distinct("order_id").alias("_no"))
    with_anchor = items.join(anchors, F.col("product_id") == F.col("anchor_id")).select("order_id", "anchor_id")
    together = (items.join(with_anchor, "order_id").where("product_id != anchor_id")
                .groupBy("anchor_id", "product_id").agg(F.count(F.lit(1)).alias("together")))
    out = (together.join(per_prod, "product_id")
           .join(per_prod.select(F.col("product_id").alias("anchor_id"), F.col("orders").alias("_an")), "anchor_id")
           .withColumn("_no", n_orders.scalar()))
    return out.select(
        "anchor_id", "product_id", "together", "orders",
        div_half_up(F.col("together") * 100, F.col("_an")).cast(DEC).alias("support_pct"),
        div_half_up(F.col("together") * F.col("_no"), F.col("_an") * F.col("orders"), 4)
        .cast("decimal(38,4)").alias("lift"))


def affinity_pairs(t, min_support: int = 2, as_of=AS_OF, days: int | None = None) -> DataFrame:
    """Product pairs bought together in at least ``min_support`` orders (a < b), with lift.

    ``days`` restricts the orders to a window before ``as_of`` (default: all orders).
    """
    items = t["order_items"].select("order_id", "product_id") if days is None else _window_items(t, days, as_of, "product_id")
    n_orders = items.where("product_id IS NOT NULL").agg(F.count_distinct("order_id").alias("_no"))
    out = frequent_pairs(items, min_support).withColumn("_no", n_orders.scalar())
    return out.select("product_a", "product_b", "together", "orders_a", "orders_b",
                      div_half_up(F.col("together") * F.col("_no"), F.col("orders_a") * F.col("orders_b"), 4)
                      .cast("decimal(38,4)").alias("lift"))


def revenue_growth(t, as_of=AS_OF, months: int = 12) -> DataFrame:
    """Month-over-month item revenue change per category (%).

    The lag window is per category over at most ``months``+1 monthly rows.
    """
    o = _since(t, months=months, as_of=as_of).select("order_id", month_index(F.col("order_date")).alias("m"))
    # sums per product and month first: a hot product is one row a month and task
    i = (t["order_items"].select("order_id", "product_id", "subtotal").join(o, "order_id")
         .groupBy("product_id", "m").agg(F.sum("subtotal").alias("rev")))
    p = t["products"].select("product_id", "category")
    per = i.join(p, "product_id").groupBy("category", "m").agg(F.sum("rev").alias("rev"))
    w = Window.partitionBy("category").orderBy("m")
    prev = F.lag("rev").over(w)
    prev_m = F.lag("m").over(w)
    prev = F.when(prev_m == F.col("m") - 1, prev)
    return per.select("category", month_label_from_index(F.col("m")).alias("month"),
                      F.col("rev").cast(DEC).alias("revenue"), prev.cast(DEC).alias("prev_revenue"),
                      div_half_up((F.col("rev") - prev) * 100, prev).cast(DEC).alias("growth_pct"))


# ------------------------------------------------------------------- reports
def sales_report(t, as_of=AS_OF, days: int = 30) -> DataFrame:
    """Orders and revenue by day and status with day subtotals and a grand total (ROLLUP)."""
    o = _since(t, days=days, as_of=as_of)
    return (o.rollup(F.to_date("order_date").alias("order_day"), "status")
            .agg(F.count(F.lit(1)).alias("total_orders"), F.sum("total_amount").cast(DEC).alias("revenue"),
                 F.grouping_id().cast("int").alias("grouping_level")))


def inventory_report(t) -> DataFrame:
    """Per warehouse: inventory rows, stock, reserved, rows below their reorder level."""
    return (t["inventory"].groupBy("warehouse_location")
            .agg(F.count(F.lit(1)).alias("inventory_rows"),
                 F.sum("quantity_available").cast("bigint").alias("stock"),
                 F.sum("quantity_reserved").cast("bigint").alias("reserved"),
                 F.count_if(F.col("quantity_available") < F.col("reorder_level")).alias("below_reorder")))


def customer_report(t) -> DataFrame:
    """Per customer kind and state: customers and loyalty points."""
    return (t["customers"].groupBy("customer_type", "state")
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.sum("loyalty_points").cast("bigint").alias("loyalty_points")))


def transaction_report(t) -> DataFrame:
    """Per gateway and status: payment rows and amount."""
    return (t["transactions"].groupBy("payment_gateway", "status")
            .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast(DEC).alias("amount")))


# ------------------------------------------------------------------- profile
PROFILE_TABLES = ("customers", "products", "inventory", "orders", "order_items", "transactions", "sessions")


def _profile(df: DataFrame, name: str) -> DataFrame:
    """One pass over a table: rows, NULLs, distinct-free min/max text per column."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for f in df.schema.fields:
        c = F.col(f.name)
        aggs += [F.count_if(c.isNull()).alias(f"n__{f.name}")]
        if not isinstance(f.dataType, (T.BooleanType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            aggs += [F.min(c).alias(f"lo__{f.name}"), F.max(c).alias(f"hi__{f.name}")]
    a = df.agg(*aggs)

    def txt(f, prefix):
        c = F.col(f"{prefix}__{f.name}")
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.cast("string")

    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
                     F.col("_rows").alias("row_count"), F.col(f"n__{f.name}").alias("null_count"),
                     txt(f, "lo").alias("min_value"), txt(f, "hi").alias("max_value"))
            for f in df.schema.fields]
    return a.select(F.inline(F.array(*rows)))


def full_table_scan(t, tables=PROFILE_TABLES) -> DataFrame:
    """Profile of every table: one aggregate per table (map-side combined), in long form."""
    return reduce(DataFrame.unionByName, [_profile(t[n], n) for n in tables])
