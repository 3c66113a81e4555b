"""Registered runs of the order-management operators.

Each builds its request batch from the given tables (so the work grows with
them) and applies one operator from :mod:`ledgerline.operators`:

* lookups (B1-B3): ids touched by last week's orders;
* loyalty (B4): one point per 10 currency units of each order of the last 30 days;
* restock (B8): the units sold in the last 30 days, put back;
* reservation (B7): every order line, in line order, against a stock cut to
  below 60 units, so that many are refused;
* pricing (B11): every order re-priced from its lines;
* order placement (B13): last week's orders replayed as new requests;
* payment status (B12): each order's status from its latest payment attempt;
* customer kind (B5): each customer's kind from its latest order;
* product price (B6): each product's price from its latest sold line;
* streamed rollup (T1): every order in slices of order time, twice;
* purge (B14), sessions (B17/B18), payments (B15/B16), audit (U5), checks (U2).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp, lit_ts
from ..operators import oltp as B
from ..operators.audit import audit_diff
from ..operators.constraints import constraint_report
from ..operators.ids import assign_ids, next_id_col
from ..operators.reserve import reserve_inventory
from ..operators.sketches import RELATIVE_ERROR, merged_customers, read_sketches, store_sketches
from ..session import materialize, scratch_dir
from ..sources.fixtures import AS_OF, SESSION_AS_OF
from ..sources.partitions import PART, append_batch, manifest, month_of, read_partitions, touched, write_partitioned
from .stored import place_orders_stored, purge_stored, stock_bucket


def _recent_orders(t, days, as_of=AS_OF):
    return t["orders"].where(F.col("order_date") >= lit_ts(as_of_minus(as_of, days)))


def as_of_minus(as_of, days):
    return as_timestamp(as_of) - _dt.timedelta(days=days)


def _recent_product_ids(t, days=7, as_of=AS_OF):
    o = _recent_orders(t, days, as_of).select("order_id")
    return t["order_items"].select("order_id", "product_id").join(o, "order_id").select("product_id").distinct()


def lookup_customers_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    ids = _recent_orders(t, days, as_of).select("customer_id").distinct()
    return B.lookup_customers(t["customers"], ids)


def lookup_products_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    return B.lookup_products(t["products"], _recent_product_ids(t, days, as_of))


def check_inventory_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    return B.check_inventory(t["inventory"], _recent_product_ids(t, days, as_of))


def loyalty_deltas(t, as_of=AS_OF, days: int = 30) -> DataFrame:
    return _recent_orders(t, days, as_of).select(
        "customer_id", F.floor(F.col("total_amount") / 10).cast("bigint").alias("points"))


def loyalty_update_job(t, as_of=AS_OF, days: int = 30) -> DataFrame:
    return B.apply_loyalty_deltas(t["customers"], loyalty_deltas(t, as_of, days))


def restock_job(t, as_of=AS_OF, days: int = 30) -> DataFrame:
    o = _recent_orders(t, days, as_of).select("order_id")
    deltas = t["order_items"].select("order_id", "product_id", "quantity").join(o, "order_id")
    return B.restock_inventory(t["inventory"], deltas.select("product_id", "quantity"))


def line_requests(t) -> DataFrame:
    """Every order line as a reservation request, numbered in (order, product, amounts) order."""
    i = t["order_items"].select("order_id", "product_id", "quantity", "unit_price", "subtotal")
    return assign_ids(i, ["order_id", "product_id", "quantity", "unit_price", "subtotal"], id_col="seq")


def scarce_inventory(t) -> DataFrame:
    """The stock cut to below 60 units a row, so that the order lines meet many refusals."""
    return t["inventory"].withColumn("quantity_available", (F.col("quantity_available") % 60).cast("bigint"))


def reserve_job(t) -> DataFrame:
    after, _ = reserve_inventory(scarce_inventory(t), line_requests(t).select("seq", "product_id", "quantity"))
    return after.select("inventory_id", "product_id", "quantity_available", "quantity_reserved")


def reserve_decisions_job(t) -> DataFrame:
    return reserve_inventory(scarce_inventory(t), line_requests(t).select("seq", "product_id", "quantity"))[1]


def lookup_latest_orders_job(t) -> DataFrame:
    """The rows of each customer's latest order, looked up by key."""
    keys = t["orders"].groupBy("customer_id").agg(F.max(F.struct("order_date", "order_id")).alias("last")).select(
        F.col("last.order_id").alias("order_id"))
    return B.lookup_by_key(t["orders"], "order_id", keys)


def price_orders_job(t) -> DataFrame:
    return B.price_orders(t["orders"], t["order_items"])


def _requests(t, as_of=AS_OF, days: int = 7) -> tuple[DataFrame, DataFrame]:
    recent = _recent_orders(t, days, as_of)
    reqs = recent.select(F.col("order_id").alias("request_id"), "customer_id", "payment_method")
    lines = (t["order_items"].select(F.col("order_id").alias("request_id"), "product_id", "quantity", "subtotal")
             .join(reqs.select("request_id"), "request_id"))
    lines = assign_ids(lines, ["request_id", "product_id", "quantity", "subtotal"], id_col="line_no")
    return reqs, lines.select("request_id", "line_no", "product_id", "quantity")


def _placed(t, as_of=AS_OF, days: int = 7, stock=None) -> dict:
    reqs, lines = _requests(t, as_of, days)
    tables = {k: t[k] for k in ("orders", "order_items", "inventory", "transactions", "products")}
    if stock is not None:
        tables["inventory"] = stock
    return B.place_orders(tables, reqs, lines, as_of)


def _placed_stored(t, as_of=AS_OF, days: int = 7) -> str:
    """Last week's orders as requests to the stored shop, twice, the second time with a batch of other requests' names."""
    spark = t["orders"].sparkSession
    root = scratch_dir(spark, "stored-shop")
    write_partitioned(t["orders"], f"{root}/orders", month_of("order_date"))
    write_partitioned(scarce_inventory(t), f"{root}/inventory", stock_bucket())
    reqs, lines = _requests(t, as_of, days)
    schemas = {n: t[n].schema for n in ("orders", "order_items", "inventory", "transactions")}
    for batch in ("week", "week-again"):
        place_orders_stored(spark, root, schemas, t["products"], reqs, lines, batch, as_of)
    return root


def stored_place_orders_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    """B13 as one stored transaction, run twice: the orders it added."""
    root = _placed_stored(t, as_of, days)
    return read_partitions(t["orders"].sparkSession, f"{root}/orders", t["orders"].schema, with_part=True).where(
        F.col(PART).startswith("batch-")).select("order_id", "customer_id", "order_date", "status", "total_amount", "payment_method")


def stored_place_stock_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    """The stock after the same two runs."""
    root = _placed_stored(t, as_of, days)
    return read_partitions(t["orders"].sparkSession, f"{root}/inventory", t["inventory"].schema).select(
        "inventory_id", "product_id", "quantity_available", "quantity_reserved")


def place_orders_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    return _placed(t, as_of, days)["new_orders"].select("order_id", "customer_id", "order_date", "status", "total_amount",
                                                        "tax_amount", "shipping_cost", "payment_method")


def placed_items_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    return _placed(t, as_of, days)["new_items"].select("order_item_id", "order_id", "product_id", "quantity", "unit_price",
                                                       "subtotal")


def placed_payments_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    return _placed(t, as_of, days)["new_transactions"].select("transaction_id", "order_id", "amount", "payment_gateway", "status")


def placed_stock_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    """Stock after last week's orders were placed against the scarce stock."""
    return _placed(t, as_of, days, scarce_inventory(t))["reserve"]()[0].select(
        "inventory_id", "product_id", "quantity_available", "quantity_reserved")


def payment_status_job(t) -> DataFrame:
    changes = t["transactions"].select(
        "order_id", F.col("transaction_id").alias("seq"),
        F.when(F.col("status") == "COMPLETED", "PAID").otherwise("PAYMENT_FAILED").alias("status"))
    return B.set_order_status(t["orders"], changes).select("order_id", "status")


def customer_kind_job(t) -> DataFrame:
    changes = t["orders"].select(
        "customer_id", F.col("order_id").alias("seq"),
        F.when(F.col("total_amount") >= 200000, "VIP").otherwise("REGULAR").alias("customer_type"))
    return B.set_customer_type(t["customers"], changes).select("customer_id", "customer_type")


def product_price_job(t) -> DataFrame:
    """Each product's price set from its most recent sold line (last write wins by order id)."""
    changes = t["order_items"].select("product_id", F.col("order_id").alias("seq"),
                                      F.col("unit_price").alias("price"))
    return B.set_product_price(t["products"], changes).select("product_id", "price")


def purge_job(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    """Rows before, after and deleted of each table: one conditional count a table."""
    doomed = B.purge_old_orders(t["orders"], t["order_items"], t["transactions"], as_of, days)["deleted_orders"].select(
        F.col("order_id").alias("doomed"))
    parts = []
    for name in ("orders", "order_items", "transactions"):
        per = t[name].groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
        gone = F.col("doomed").isNotNull()
        parts.append(per.join(doomed, F.col("order_id") == F.col("doomed"), "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_before"),
            F.coalesce(F.sum(F.when(~gone, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_after"),
            F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_deleted"))
            .select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def purged_orders_job(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    return B.purge_old_orders(t["orders"], t["order_items"], t["transactions"], as_of, days)["orders"].select(
        "order_id", "customer_id", "status", "total_amount")


def purged_items_job(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    return B.purge_old_orders(t["orders"], t["order_items"], t["transactions"], as_of, days)["order_items"].select(
        "order_id", "product_id", "quantity", "unit_price", "subtotal")


def purged_transactions_job(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    return B.purge_old_orders(t["orders"], t["order_items"], t["transactions"], as_of, days)["transactions"].select(
        "transaction_id", "order_id", "amount", "status")


def end_idle_sessions_job(t, as_of=SESSION_AS_OF, idle_hours: int = 12) -> DataFrame:
    cutoff = as_timestamp(as_of) - _dt.timedelta(hours=idle_hours)
    idle = t["sessions"].where((F.col("is_active") == 1) & (F.col("last_activity") < lit_ts(cutoff)))
    return B.end_sessions(t["sessions"], idle.select("session_id")).select("session_id", "customer_id", "is_active")


def create_sessions_job(t, as_of=SESSION_AS_OF) -> DataFrame:
    """A new session per customer active on the last day of the event log."""
    last_day = as_timestamp(as_of) - _dt.timedelta(days=1)
    reqs = (t["sessions"].where(F.col("login_time") >= lit_ts(last_day)).select("customer_id").distinct()
            .select(F.col("customer_id").alias("request_id"), "customer_id"))
    return B.create_sessions(reqs, as_of).select("session_id", "customer_id", "login_time", "last_activity",
                                                 "ip_address", "is_active")


def process_payments_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    ids = _recent_orders(t, days, as_of).select("order_id")
    start = next_id_col(t["transactions"], "transaction_id")
    return B.process_transactions(ids, start, as_of).select(
        "transaction_id", "order_id", "transaction_type", "amount", "payment_gateway", "status", "currency", "processed_at")


def audit_loyalty_job(t, as_of=AS_OF, days: int = 30) -> DataFrame:
    before = t["customers"].select("customer_id", "customer_type", "loyalty_points")
    after = loyalty_update_job(t, as_of, days).select("customer_id", "customer_type", "loyalty_points")
    return audit_diff(before, after, "customer_id", "CUSTOMERS", as_of=as_of)


def broken_tables(t) -> dict:
    """The shop tables with violations derived from their own rows; a price column is absent."""
    c, p = t["customers"], t["products"]
    return {"customers": c.where("customer_id % 7 <> 0").withColumn(
                "email", F.when(F.col("customer_id") % 11 == 0, None).when(F.col("customer_id") % 13 == 0, "same@example.com")
                .otherwise(F.col("email"))),
            "products": p.unionByName(p.where("product_id % 50 = 0")).drop("price"),
            "inventory": t["inventory"].withColumn("product_id", F.when(F.col("product_id") % 17 != 0, F.col("product_id"))),
            "orders": t["orders"], "order_items": t["order_items"].where("product_id % 3 <> 0 OR order_id % 2 = 0"),
            "transactions": t["transactions"].withColumn("order_id", F.col("order_id") + F.when(
                F.col("order_id") % 10 == 3, F.lit(100_000_000)).otherwise(F.lit(0)))}


def broken_constraint_report_job(t) -> DataFrame:
    return constraint_report(broken_tables(t))


def constraint_report_job(t) -> DataFrame:
    return constraint_report({"customers": t["customers"], "products": t["products"],
                              "inventory": t["inventory"], "orders": t["orders"],
                              "order_items": t["order_items"], "transactions": t["transactions"]})


def streamed_sales_summary(t, slices: int = 3) -> DataFrame:
    """T1 over all orders: they arrive in slices of order time, each first as pending without a price and then as they are.

    Every slice is one run of the stream from its checkpoint; a last one
    delivers the newest week again.
    """
    from ..streaming import read_order_stream, read_sales_summary, start_sales_summary_stream

    spark = t["orders"].sparkSession
    root = scratch_dir(spark, "order-stream")
    orders = t["orders"].select("order_id", "customer_id", "order_date", "status", "total_amount", "payment_method")
    first, last = orders.agg(F.min("order_date"), F.max("order_date")).first()
    if first is None:
        return orders.select(F.to_date("order_date").alias("summary_date"), F.lit(0).cast("bigint").alias("total_orders"),
                             F.col("total_amount").cast("decimal(15,2)").alias("total_revenue")).where("false")
    cuts = [first + (last - first) * k / slices for k in range(slices)] + [last + _dt.timedelta(microseconds=1)]
    spans = [*zip(cuts[:-1], cuts[1:], strict=True), (last - _dt.timedelta(days=7), cuts[-1])]
    for k, (lo, hi) in enumerate(spans):
        part = orders.where((F.col("order_date") >= lit_ts(lo)) & (F.col("order_date") < lit_ts(hi)))
        early = part.withColumn("status", F.lit("PENDING")).withColumn("total_amount", F.lit(None).cast("decimal(12,2)"))
        (early.unionByName(part) if k < slices else part).write.mode("append").parquet(f"{root}/in")
        start_sales_summary_stream(read_order_stream(spark, f"{root}/in"), f"{root}/target", f"{root}/checkpoint",
                                   as_of=AS_OF).awaitTermination()
    return read_sales_summary(spark, f"{root}/target").select("summary_date", "total_orders", "total_revenue")


def stored_purge_job(t, as_of=AS_OF, days: int = 90) -> DataFrame:
    """B14 on stored tables partitioned by the order's month: only months with doomed orders are read and written.

    Per table: its rows after the purge, its partitions before and after, and how many were written anew.
    """
    spark = t["orders"].sparkSession
    root = scratch_dir(spark, "stored-shop")
    month = t["orders"].select("order_id", month_of("order_date").alias(PART))
    names = ("orders", "order_items", "transactions")
    for name in names:
        rows = t[name].join(month, "order_id")
        write_partitioned(rows, f"{root}/{name}", F.col(PART))
    before = {n: manifest(spark, f"{root}/{n}") for n in names}
    purge_stored(spark, root, {n: t[n].schema for n in names}, as_of, days)
    out = []
    for n in names:
        after = manifest(spark, f"{root}/{n}")
        fresh = sum(after.get(v) != x for v, x in before[n].items())
        out.append(read_partitions(spark, f"{root}/{n}", t[n].schema).agg(F.count(F.lit(1)).alias("rows_after")).select(
            F.lit(n).alias("table_name"), "rows_after", F.lit(len(before[n])).cast("bigint").alias("partitions_before"),
            F.lit(len(after)).cast("bigint").alias("partitions_after"), F.lit(fresh).cast("bigint").alias("partitions_replaced")))
    return reduce(DataFrame.unionByName, out)


def stored_payments_job(t, as_of=AS_OF, days: int = 7) -> DataFrame:
    """R5 with B16: a payment for each of last week's orders, appended in a batch a day, every batch run twice."""
    spark = t["orders"].sparkSession
    path = f"{scratch_dir(spark, 'payments')}/transactions"
    orders = _recent_orders(t, days, as_of).select("order_id", F.date_format("order_date", "yyyy-MM-dd").alias("day"))
    paid = B.process_transactions(orders.select("order_id"), 1, as_of).drop("transaction_id").join(orders, "order_id")
    paid = materialize(paid, "payments")
    for day in touched(orders, F.col("day")):
        for _ in range(2):
            append_batch(paid.where(F.col("day") == day).drop("day"), path, day, "transaction_id", ["order_id"])
    schema = ("transaction_id bigint, order_id bigint, transaction_type string, amount decimal(12,2), payment_gateway string, "
              "status string, currency string, processed_at timestamp_ntz")
    return read_partitions(spark, path, schema)


def sketched_customers_job(t) -> DataFrame:
    """Distinct customers per month from stored daily sketches, held against the exact count.

    ``within_bound`` tells whether the estimate is within three standard errors.
    """
    spark = t["orders"].sparkSession
    path = f"{scratch_dir(spark, 'sketches')}/daily_customers"
    store_sketches(spark, path, t["orders"])
    by_month = merged_customers(read_sketches(spark, path), F.date_format("order_day", "yyyy-MM").alias("order_month"))
    exact = (t["orders"].select(F.date_format("order_date", "yyyy-MM").alias("order_month"), "customer_id").distinct()
             .groupBy("order_month").agg(F.count("customer_id").alias("exact_customers")))
    off = F.abs(F.col("customers") - F.col("exact_customers"))
    return by_month.join(exact, "order_month").select(
        "order_month", "orders", "exact_customers", (off <= F.ceil(F.col("exact_customers") * 3 * RELATIVE_ERROR)).alias("within_bound"))
