"""The analytical statements of the retail workload.

Every function takes the table dict (see :func:`ledgerline.sources.load_tables`)
plus a frozen ``as_of`` clock, and returns a lazy DataFrame.  Results keep the
reference semantics, including join fan-out, unless ``dedup=True`` is passed.

Plan notes that hold for all of them:
* the clock bounds are Python literals, so ``order_date >= <literal>`` lands in
  the parquet scan's PushedFilters;
* ``order_id`` / ``customer_id`` / ``product_id`` are primary keys, so a
  COUNT(DISTINCT key) after grouping by a coarser key is a plain count; that
  avoids Spark's Expand-based distinct aggregation and lets every aggregate
  combine map-side (hot keys collapse before the shuffle);
* fan-out (one order row per item x warehouse x payment row) is computed as
  multiplicities on pre-aggregated rows instead of materialising the product.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (add_months_sticky, as_timestamp, day_start, int_div, lit_ts, month_index,
                         month_label_from_index, concat_null_as_empty, order_desc)
from ..session import materialize
from ..sources.fixtures import AS_OF

DEC = "decimal(38,2)"


def _orders_since(t, lo, *cols) -> DataFrame:
    o = t["orders"]
    return o.where(F.col("order_date") >= lit_ts(lo)).select(*cols) if cols else \
        o.where(F.col("order_date") >= lit_ts(lo))


# --------------------------------------------------------------------------- Q3
def monthly_sales(t, as_of=AS_OF, months: int = 12) -> DataFrame:
    """Orders and revenue per calendar month since ``as_of - months`` (sticky month end)."""
    lo = add_months_sticky(as_of, -months)
    o = _orders_since(t, lo, "order_id", "order_date", "total_amount")
    agg = (o.groupBy(month_index(F.col("order_date")).alias("_m"))
           .agg(F.count("order_id").alias("total_orders"),
                F.sum("total_amount").cast(DEC).alias("revenue")))
    return (agg.select(month_label_from_index(F.col("_m")).alias("order_month"), "total_orders", "revenue")
            .orderBy(F.col("order_month").desc()))


# --------------------------------------------------------------------------- Q2
def daily_sales(t, as_of=AS_OF, days: int = 30, dedup: bool = False) -> DataFrame:
    """Orders and revenue per day for orders with at least one item.

    Reference semantics: revenue sums the order total once per item row.  The
    per-order item count is taken right after the join (which is partitioned
    by order_id already), so the day aggregate sees one row per order.
    """
    lo = as_timestamp(as_of) - _dt.timedelta(days=days)
    o = _orders_since(t, lo, "order_id", "order_date", "total_amount")
    per_order = (o.join(t["order_items"].select("order_id"), "order_id")
                 .groupBy("order_id", "order_date", "total_amount").agg(F.count(F.lit(1)).alias("_n")))
    weight = F.lit(1) if dedup else F.col("_n")
    return (per_order.groupBy(F.to_date("order_date").alias("order_day"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 F.sum(F.col("total_amount") * weight).cast(DEC).alias("revenue"))
            .orderBy(F.col("order_day").desc()))


# --------------------------------------------------------------------------- Q4
def customer_retention(t, as_of=AS_OF, months: int = 12) -> DataFrame:
    """Share of each month's customers who order again in the following month.

    One shuffle on (customer, month): each order emits "active in m" and
    "active in m-1's next month"; map-side combine collapses a customer's
    many orders to at most two flags per month before anything moves.
    """
    lo = add_months_sticky(as_of, -months)
    o = _orders_since(t, lo, "customer_id", "order_date")
    m = month_index(F.col("order_date"))
    flags = (o.select("customer_id", F.explode(F.array(
                F.struct(m.alias("month"), F.lit(1).alias("this"), F.lit(0).alias("nxt")),
                F.struct((m - 1).alias("month"), F.lit(0).alias("this"), F.lit(1).alias("nxt")))).alias("f"))
             .groupBy("customer_id", F.col("f.month").alias("month"))
             .agg(F.max("f.this").alias("this"), F.max("f.nxt").alias("nxt"))
             .where(F.col("this") == 1))
    per_month = flags.groupBy("month").agg(F.count(F.lit(1)).alias("customers_this_month"),
                                           F.sum("nxt").cast("bigint").alias("customers_next_month"))
    n, k = F.col("customers_this_month"), F.col("customers_next_month")
    # ROUND(k*100/n, 2) in exact integer arithmetic: hundredths, half up
    hundredths = F.when(n != 0, int_div(F.lit(20000) * k + n, F.lit(2) * n))
    rate = (hundredths.cast("decimal(38,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(10,2)")
    return (per_month.select(month_label_from_index(F.col("month")).alias("month"), "customers_this_month",
                             "customers_next_month", rate.alias("retention_rate"))
            .orderBy(F.col("month").desc()))


# --------------------------------------------------------------------------- Q5
def product_performance(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    """Units and revenue per active product.

    Reference semantics: the date condition sits in the ON clause of an outer
    join whose columns are never used, so it filters nothing and units and
    revenue are all-time.  That join cannot fan out (order_id is the key of
    orders) and is therefore left out.  Items are aggregated per product
    before the join, so a hot product is a single row per map task.
    """
    del as_of, days  # inert in the reference statement; kept for the signature
    sold = t["order_items"].groupBy("product_id").agg(F.sum("quantity").alias("_u"),
                                                      F.sum("subtotal").alias("_r"))
    p = t["products"].where(F.col("is_active") == 1).select("product_id", "product_name", "category")
    return (p.join(sold, "product_id", "left")
            .select("product_id", "product_name", "category",
                    F.coalesce(F.col("_u"), F.lit(0)).cast("bigint").alias("total_units_sold"),
                    F.coalesce(F.col("_r"), F.lit(0)).cast(DEC).alias("total_revenue"))
            .orderBy(order_desc("total_revenue"), "product_id"))


# --------------------------------------------------------------------------- Q6
def executive_dashboard(t, as_of=AS_OF) -> DataFrame:
    """Orders and revenue for today and yesterday, as two rows.

    One pass over a two-day range (pushed to the scan) with conditional
    aggregates replaces four scalar subqueries.  Empty revenue stays NULL.
    """
    today = day_start(as_of)
    yday = today - _dt.timedelta(days=1)
    o = t["orders"].where((F.col("order_date") >= lit_ts(yday)) &
                          (F.col("order_date") < lit_ts(today + _dt.timedelta(days=1))))
    is_today = F.col("order_date") >= lit_ts(today)
    a = o.agg(F.count_if(is_today).alias("tc"), F.count_if(~is_today).alias("yc"),
              F.sum(F.when(is_today, F.col("total_amount"))).alias("tr"),
              F.sum(F.when(~is_today, F.col("total_amount"))).alias("yr"))
    num = "decimal(38,0)"
    return a.select(F.inline(F.array(
        F.struct(F.lit("Orders").alias("metric"), F.col("tc").cast(num).alias("today_count"),
                 F.col("yc").cast(num).alias("yesterday_count")),
        F.struct(F.lit("Revenue").alias("metric"), F.round("tr", 0).cast(num).alias("today_count"),
                 F.round("yr", 0).cast(num).alias("yesterday_count")))))


# --------------------------------------------------------------------------- Q8
def customer_activity(t, as_of=AS_OF, days: int = 90, limit: int | None = 100) -> DataFrame:
    """Orders and items per customer with an order in the last ``days`` days.

    The reference LEFT JOINs are inner for customers/orders (WHERE on the
    order date), and items only add counts, so which customers appear is
    decided by orders and customers alone: the first ``limit`` customer ids
    come from a distributed top-k over distinct ids (the reference takes 100
    arbitrary rows; we take the first ids).  Only those customers' orders
    meet the items (a semi join pushed below the items projection); items are
    summed per order, then per customer.
    """
    lo = as_timestamp(as_of) - _dt.timedelta(days=days)
    c = t["customers"].select("customer_id", concat_null_as_empty("first_name", F.lit(" "), "last_name")
                              .alias("customer_name"))
    o = _orders_since(t, lo, "order_id", "customer_id")
    if limit is not None:
        # ids in order: the last of the first `limit` customers with orders is a literal for the scan
        last = (o.select("customer_id").distinct().join(c.select("customer_id"), "customer_id", "left_semi")
                .orderBy("customer_id").limit(limit).agg(F.max("customer_id")).first()[0])
        o = o.where(F.col("customer_id") <= F.lit(last))
        c = c.where(F.col("customer_id") <= F.lit(last))
    items = t["order_items"].select("order_id", "quantity").join(o.select("order_id"), "order_id", "left_semi")
    per_item = items.groupBy("order_id").agg(F.sum("quantity").alias("_q"))
    per_cust = o.join(per_item, "order_id", "left").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("_q").cast("bigint").alias("total_items"))
    return (per_cust.join(c, "customer_id").select("customer_id", "customer_name", "order_count", "total_items")
            .orderBy("customer_id"))


# --------------------------------------------------------------------------- Q9
def sessions_by_user(t, types=("PREMIUM", "VIP")) -> DataFrame:
    """Sessions per account kind, restricted to an IN list (the documented monitoring query
    re-aimed at SESSION_DATA: account kind plays the role of the database user)."""
    s = t["sessions"].select("customer_id", "is_active")
    c = t["customers"].where(F.col("customer_type").isin(list(types))).select("customer_id", "customer_type")
    return (s.join(c, "customer_id")
            .groupBy("customer_type")
            .agg(F.count(F.lit(1)).alias("session_count"),
                 F.sum("is_active").cast("bigint").alias("active_sessions")))


# --------------------------------------------------------------------------- Q1
Q1_COLUMNS = [
    "customer_id", "customer_name", "email", "customer_type", "loyalty_points", "customer_total_orders",
    "customer_lifetime_value", "customer_order_rank", "order_id", "order_date", "order_status", "order_total",
    "payment_method", "product_id", "product_name", "product_category", "quantity", "unit_price", "subtotal",
    "inventory_available", "transaction_id", "transaction_status", "payment_gateway", "order_recency",
    "customer_value_segment",
]


def _q1_order_weights(t, o: DataFrame, items: DataFrame, dedup: bool) -> DataFrame:
    """Rows of the 6-way join per order of ``o``, without building the join.

    rows(order) = sum over its items with a known product of
    max(1, #inventory rows of the product), times max(1, #transactions).
    One per-product table carries both the product-exists test and the
    warehouse multiplicity, so items take a single join before collapsing to
    one row per order.  ``items`` holds (at least) the lines of ``o``'s orders.
    """
    items = items.select("order_id", "product_id")
    prods = t["products"].select("product_id")
    if dedup:
        has_item = items.join(prods, "product_id", "left_semi").select("order_id").distinct()
        return o.join(has_item, "order_id").withColumn("_rows", F.lit(1).cast("bigint"))
    inv_n = t["inventory"].groupBy("product_id").agg(F.count(F.lit(1)).alias("_ni"))
    prod_w = prods.join(inv_n, "product_id", "left").select(
        "product_id", F.coalesce(F.col("_ni"), F.lit(1)).alias("_w"))
    tx_n = (t["transactions"].select("order_id").join(o.select("order_id"), "order_id", "left_semi")
            .groupBy("order_id").agg(F.count(F.lit(1)).alias("_nt")))
    item_w = items.join(prod_w, "product_id").groupBy("order_id").agg(F.sum("_w").alias("_iw"))
    return (o.join(item_w, "order_id").join(tx_n, "order_id", "left")
            .withColumn("_rows", (F.col("_iw") * F.coalesce(F.col("_nt"), F.lit(1))).cast("bigint")))


def customer_order_detail(t, as_of=AS_OF, months: int = 24, limit: int = 500,
                          dedup: bool = False) -> DataFrame:
    """The heavy read: order detail rows of the first customers, with per-customer
    windows (joined-row count, lifetime value, rank by order date), sorted by
    customer, newest order, largest line; the first ``limit`` rows.

    One plan for every size; no window over the full join, no unbounded sort:
    1. (customer, order time) groups of orders that have a line with a known
       product, so each holds one row at least; the customer id of the last
       of the first ``limit`` groups, taken once, is a literal that bounds
       the scan of orders from then on;
    2. join multiplicities (items x warehouses x payments) of those
       customers' orders, from order and product ids alone, summed per group
       and written once;
    3. the first ``limit`` groups by a top-k, running positions and ranks as
       windows over at most ``limit`` rows, lifetime totals, then the detail
       rows of the chosen groups only and the final ordered top-k.
    """
    lo = add_months_sticky(as_of, -months)
    o = (_orders_since(t, lo, "order_id", "customer_id", "order_date", "total_amount", "status", "payment_method")
         .join(t["customers"].select("customer_id"), "customer_id", "left_semi"))
    item_cols = ["order_id", "product_id", "quantity", "unit_price", "subtotal"]
    known = t["order_items"].select("order_id", "product_id").join(t["products"].select("product_id"), "product_id", "left_semi")
    live = o.select("order_id", "customer_id", "order_date").join(known.select("order_id"), "order_id", "left_semi")
    last_id = (live.select("customer_id", "order_date").distinct()
               .orderBy(F.col("customer_id").asc(), F.col("order_date").desc()).limit(max(limit, 1))
               .agg(F.max("customer_id")).first()[0])
    orders = o.where(F.col("customer_id") <= F.lit(last_id))
    lines = t["order_items"].join(orders.select("order_id"), "order_id", "left_semi").select("order_id", "product_id")
    cd = materialize(_q1_order_weights(t, orders, lines, dedup).groupBy("customer_id", "order_date").agg(
        F.sum("_rows").alias("_g"), F.sum(F.col("total_amount") * F.col("_rows")).alias("_v")), "q1-day-weights")

    first = cd.orderBy(F.col("customer_id").asc(), F.col("order_date").desc()).limit(limit)
    w_all = (Window.orderBy(F.col("customer_id").asc(), F.col("order_date").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    w_c = (Window.partitionBy("customer_id").orderBy(F.col("order_date").desc())
           .rowsBetween(Window.unboundedPreceding, -1))
    first = (first.withColumn("_gbefore", F.coalesce(F.sum("_g").over(w_all), F.lit(0)))
             .withColumn("_before", F.coalesce(F.sum("_g").over(w_c), F.lit(0)))
             .where(F.col("_gbefore") < limit))
    totals = cd.join(first.select("customer_id").distinct(), "customer_id").groupBy("customer_id").agg(
        F.sum("_g").alias("customer_total_orders"),
        F.sum("_v").cast(DEC).alias("customer_lifetime_value"))
    groups = first.join(totals, "customer_id").select(
        "customer_id", "order_date", "customer_total_orders", "customer_lifetime_value",
        (F.col("_before") + 1).cast("bigint").alias("customer_order_rank"))

    o = orders.select("order_id", "customer_id", "order_date", F.col("status").alias("order_status"),
                      F.col("total_amount").alias("order_total"), "payment_method")
    c = t["customers"].select("customer_id", concat_null_as_empty("first_name", F.lit(" "), "last_name")
                              .alias("customer_name"), "email", "customer_type", "loyalty_points")
    sel = o.join(groups, ["customer_id", "order_date"])
    sel_ids = sel.select("order_id")
    # semi joins on the raw key first: the filter lands below the items/payments
    # projections, so only the selected orders' lines are priced and joined
    i = t["order_items"].join(sel_ids, "order_id", "left_semi").select(*item_cols)
    p = t["products"].select("product_id", "product_name", F.col("category").alias("product_category"))
    inv = t["inventory"].select("product_id", "inventory_id",
                                F.col("quantity_available").alias("inventory_available"))
    tx = (t["transactions"].join(sel_ids, "order_id", "left_semi")
          .select("order_id", "transaction_id", F.col("status").alias("transaction_status"), "payment_gateway"))

    detail = (sel.join(c, "customer_id").join(i, "order_id").join(p, "product_id")
              .join(inv, "product_id", "left").join(tx, "order_id", "left"))

    recent, moderate = add_months_sticky(as_of, -1), add_months_sticky(as_of, -6)
    ltv = F.col("customer_lifetime_value")
    detail = detail.withColumn(
        "order_recency", F.when(F.col("order_date") >= lit_ts(recent), "RECENT")
        .when(F.col("order_date") >= lit_ts(moderate), "MODERATE").otherwise("OLD")
    ).withColumn(
        "customer_value_segment", F.when(ltv >= 1000, "HIGH_VALUE").when(ltv >= 500, "MEDIUM_VALUE")
        .otherwise("LOW_VALUE"))
    order = [F.col("customer_id").asc(), order_desc("order_date"), order_desc("subtotal"),
             F.col("order_id").asc(), F.col("product_id").asc(), F.col("quantity").asc(),
             F.col("unit_price").asc(), F.col("inventory_id").asc_nulls_last(),
             F.col("transaction_id").asc_nulls_last()]
    return detail.orderBy(*order).limit(limit).select(*Q1_COLUMNS)
