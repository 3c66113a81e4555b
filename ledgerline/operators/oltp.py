"""Order-management steps as set-based jobs.

The reference changes one row per call; here each step applies a batch of
requests (a DataFrame) to a table and returns the new table.  Nothing runs
row by row on the driver: lookups are joins, per-key deltas are combined
map-side before they meet the table, "last write wins" is one aggregate.
Persisting a result is a separate step (``sources.sinks``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp, hash_choice, hash_int_between, lit_ts
from .defaults import apply_defaults, default_value
from .ids import assign_ids, next_id
from .reserve import reserve_inventory

# Fixed values from the workload.
ORDER_STATUS_NEW = "PENDING"
ORDER_STATUS_DONE = "COMPLETED"
PURGE_STATUSES = ("COMPLETED", "DELIVERED")
DEFAULT_PAYMENT_METHOD = "CREDIT_CARD"
PLACE_ORDER_GATEWAY = "STRIPE"
GATEWAYS = ("STRIPE", "PAYPAL", "SQUARE")
TAX_RATE = "0.08"
FREE_SHIPPING_ABOVE = 100
FLAT_SHIPPING = 10

CUSTOMER_LOOKUP_COLS = ["customer_id", "first_name", "last_name", "email", "customer_type", "loyalty_points"]
PRODUCT_LOOKUP_COLS = ["product_id", "product_name", "category", "subcategory", "price", "cost", "is_active"]


# ----------------------------------------------------------------- R3 key lookup
def lookup_by_key(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``key`` is among ``keys`` (a DataFrame): a semi join planned by AQE."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def lookup_by_literals(table: DataFrame, key: str, *values) -> DataFrame:
    """Rows whose ``key`` equals one of the values written out in the call (a point lookup).

    The predicate ``key IN (...)`` reaches the parquet scan and skips row
    groups; for key sets that come from data use :func:`lookup_by_key`.
    """
    return table.where(F.col(key).isin(list(values)))


# ----------------------------------------------------------------- B1-B3 lookups
def lookup_customers(customers: DataFrame, ids: DataFrame) -> DataFrame:
    """B1: the six customer columns per requested id; unknown ids give NULLs (the 404 case)."""
    c = customers.select(*CUSTOMER_LOOKUP_COLS)
    return ids.select("customer_id").join(c, "customer_id", "left").select(*CUSTOMER_LOOKUP_COLS)


def lookup_products(products: DataFrame, ids: DataFrame) -> DataFrame:
    """B2: the seven product columns per requested id; unknown ids give NULLs."""
    p = products.select(*PRODUCT_LOOKUP_COLS)
    return ids.select("product_id").join(p, "product_id", "left").select(*PRODUCT_LOOKUP_COLS)


def check_inventory(inventory: DataFrame, ids: DataFrame, per_row: bool = False) -> DataFrame:
    """Quantity available per requested product (0 when it has no inventory row).

    With several warehouses the total is returned; ``per_row=True`` returns
    one row per inventory row instead.
    """
    if per_row:
        return (ids.select("product_id").join(
            inventory.select("product_id", "inventory_id", "quantity_available"), "product_id", "left")
            .select("product_id", "inventory_id",
                    F.coalesce(F.col("quantity_available"), F.lit(0)).cast("bigint").alias("quantity_available")))
    stock = inventory.groupBy("product_id").agg(F.sum("quantity_available").alias("_q"))
    return (ids.select("product_id").join(stock, "product_id", "left")
            .select("product_id", F.coalesce(F.col("_q"), F.lit(0)).cast("bigint").alias("quantity_available")))


# ----------------------------------------------------------------- B4-B6, B12 updates
def apply_loyalty_deltas(customers: DataFrame, deltas: DataFrame) -> DataFrame:
    """loyalty_points += sum of the deltas per customer; unknown ids are ignored,
    a NULL balance stays NULL (NULL + n)."""
    d = deltas.groupBy("customer_id").agg(F.sum("points").alias("_d"))
    return (customers.join(d, "customer_id", "left")
            .withColumn("loyalty_points",
                        F.when(F.col("_d").isNull(), F.col("loyalty_points"))
                        .otherwise(F.col("loyalty_points") + F.col("_d")).cast("bigint"))
            .select(*customers.columns))


def apply_last_write(target: DataFrame, changes: DataFrame, key: str, col: str, seq: str = "seq") -> DataFrame:
    """Set ``col`` from the change with the highest ``seq`` per key (last write wins).

    An explicit NULL in the winning change is written as NULL; keys without a
    change keep their value; changes for unknown keys are ignored.
    """
    last = (changes.groupBy(key)
            .agg(F.max(F.struct(F.col(seq).alias("s"), F.col(col).alias("v"))).alias("_w")))
    return (target.join(last, key, "left")
            .withColumn(col, F.when(F.col("_w").isNull(), F.col(col)).otherwise(F.col("_w.v"))
                        .cast(target.schema[col].dataType))
            .select(*target.columns))


def set_customer_type(customers: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(customer_id, customer_type, seq)."""
    return apply_last_write(customers, changes, "customer_id", "customer_type")


def set_product_price(products: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(product_id, price, seq)."""
    return apply_last_write(products, changes, "product_id", "price")


def set_order_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(order_id, status, seq)."""
    return apply_last_write(orders, changes, "order_id", "status")


# ----------------------------------------------------------------- B8 restock
def restock_inventory(inventory: DataFrame, deltas: DataFrame, as_of=None) -> DataFrame:
    """quantity_available += sum of deltas(product_id, quantity) on every inventory row
    of the product (duplicates add up); last_restock_date is set when given a clock."""
    d = deltas.groupBy("product_id").agg(F.sum("quantity").alias("_d"))
    out = inventory.join(d, "product_id", "left").withColumn(
        "quantity_available", (F.col("quantity_available") + F.coalesce(F.col("_d"), F.lit(0))).cast("bigint"))
    if as_of is not None and "last_restock_date" in inventory.columns:
        out = out.withColumn("last_restock_date",
                             F.when(F.col("_d").isNotNull(), lit_ts(as_of)).otherwise(F.col("last_restock_date")))
    return out.select(*inventory.columns)


# ----------------------------------------------------------------- B9-B11 orders
def create_orders(requests: DataFrame, start_id: int, as_of) -> DataFrame:
    """One new PENDING order per request(request_id, customer_id[, payment_method]).

    Ids follow request_id order from ``start_id``; total/tax/shipping stay NULL.
    """
    pm = F.col("payment_method") if "payment_method" in requests.columns else F.lit(None)
    base = requests.select("request_id", "customer_id",
                           F.coalesce(pm, F.lit(DEFAULT_PAYMENT_METHOD)).alias("payment_method"))
    new = assign_ids(base, ["request_id"], id_col="order_id", start=start_id)
    return new.select("request_id", "order_id", "customer_id", lit_ts(as_of).alias("order_date"),
                      F.lit(ORDER_STATUS_NEW).alias("status"),
                      F.lit(None).cast("decimal(12,2)").alias("total_amount"),
                      F.lit(None).cast("decimal(10,2)").alias("tax_amount"),
                      F.lit(None).cast("decimal(8,2)").alias("shipping_cost"),
                      "payment_method", lit_ts(as_of).alias("created_at"))


def add_order_items(lines: DataFrame, products: DataFrame, start_id: int) -> DataFrame:
    """lines(order_id, line_no, product_id, quantity) -> item rows priced from products.

    subtotal = quantity * price; a line whose product is unknown is skipped.
    """
    p = products.select("product_id", F.col("price").alias("unit_price"))
    priced = lines.join(p, "product_id").select(
        "order_id", "line_no", "product_id", F.col("quantity").cast("bigint").alias("quantity"),
        F.col("unit_price").cast("decimal(10,2)").alias("unit_price"),
        F.lit(0).cast("decimal(8,2)").alias("discount"),
        (F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)").alias("subtotal"))
    return assign_ids(priced, ["order_id", "line_no"], id_col="order_item_id", start=start_id)


def price_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """(order_id, items_total, tax_amount, shipping_cost, total_amount) per order.

    tax 8 %, shipping 0 above 100 else 10; an order without items costs 10.
    Stored scales round half up as the target column types do.
    """
    s = items.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("_s"))
    j = orders.select("order_id").join(s, "order_id", "left")
    amount = F.coalesce(F.col("_s"), F.lit(0).cast("decimal(10,2)"))
    tax = amount * F.lit(TAX_RATE).cast("decimal(3,2)")
    ship = F.when(amount > FREE_SHIPPING_ABOVE, F.lit(0)).otherwise(F.lit(FLAT_SHIPPING)).cast("decimal(8,2)")
    return j.select("order_id", amount.cast("decimal(38,2)").alias("items_total"),
                    tax.cast("decimal(10,2)").alias("tax_amount"), ship.alias("shipping_cost"),
                    (amount + tax + ship).cast("decimal(12,2)").alias("total_amount"))


# ----------------------------------------------------------------- B15-B16 payments
def record_transactions(payments: DataFrame, start_id: int, as_of) -> DataFrame:
    """payments(order_id, amount, payment_gateway) -> COMPLETED PAYMENT rows in USD.

    The payment method is accepted by the reference but not stored, so it is
    not an input here.
    """
    rows = payments.select("order_id", F.col("amount").cast("decimal(12,2)").alias("amount"),
                           "payment_gateway")
    new = assign_ids(rows, ["order_id", "payment_gateway", "amount"], id_col="transaction_id", start=start_id)
    return apply_defaults(new.select("transaction_id", "order_id", F.lit("PAYMENT").alias("transaction_type"),
                                     "amount", "payment_gateway", F.lit("COMPLETED").alias("status"),
                                     lit_ts(as_of).alias("processed_at")), "transactions", as_of)


def process_transactions(order_ids: DataFrame, start_id: int, as_of, seed: int = 0) -> DataFrame:
    """A payment per order with a gateway drawn from three and an amount in [50, 500)
    (repeatable: drawn from a hash of the order id)."""
    pay = order_ids.select("order_id", hash_choice(list(GATEWAYS), "order_id", seed=seed).alias("payment_gateway"),
                           hash_int_between(50, 500, "order_id", seed=seed + 1).alias("amount"))
    return record_transactions(pay, start_id, as_of)


# ----------------------------------------------------------------- B13 pipeline
def place_orders(t: dict, order_requests: DataFrame, line_requests: DataFrame, as_of) -> dict:
    """Create orders, price their lines, reserve stock, total them, pay and complete.

    order_requests(request_id, customer_id[, payment_method]);
    line_requests(request_id, line_no, product_id, quantity).
    As in the reference, a refused reservation does not stop the order.
    Returns the new tables plus ``new_orders`` / ``new_items`` /
    ``new_transactions``; ``reserve()`` runs the reservation and returns the
    inventory after it and the decisions, so that only callers who want the
    stock pay for its rounds.
    """
    orders, items, inv, txns = t["orders"], t["order_items"], t["inventory"], t["transactions"]
    new_orders = create_orders(order_requests, next_id(orders, "order_id"), as_of)
    lines = line_requests.join(new_orders.select("request_id", "order_id"), "request_id")
    new_items = add_order_items(lines.select("order_id", "line_no", "product_id", "quantity"),
                                t["products"], next_id(items, "order_item_id") if "order_item_id" in items.columns
                                else 1)
    priced = price_orders(new_orders, new_items)
    done = (new_orders.drop("total_amount", "tax_amount", "shipping_cost", "status")
            .join(priced, "order_id")
            .withColumn("status", F.lit(ORDER_STATUS_DONE)))
    pay = done.select("order_id", F.col("total_amount").alias("amount"),
                      F.lit(PLACE_ORDER_GATEWAY).alias("payment_gateway"))
    new_tx = record_transactions(pay, next_id(txns, "transaction_id"), as_of)
    # the new rows in the target's layout; columns the pipeline does not set take the DDL default
    new_order_rows = done.select(*[
        (F.col(f.name) if f.name in done.columns else default_value("orders", f.name, as_of))
        .cast(f.dataType).alias(f.name) for f in orders.schema.fields])
    return {
        "orders": orders.unionByName(new_order_rows),
        "order_items": items.unionByName(new_items.drop("line_no"), allowMissingColumns=True),
        "transactions": txns.unionByName(new_tx, allowMissingColumns=True),
        "new_orders": done, "new_items": new_items, "new_transactions": new_tx,
        "reserve": lambda: reserve_inventory(inv, new_items.select(F.col("order_item_id").alias("seq"), "product_id", "quantity")),
    }


# ----------------------------------------------------------------- B14 purge
def purge_old_orders(orders: DataFrame, items: DataFrame, txns: DataFrame, as_of, days: int = 90) -> dict:
    """Delete COMPLETED/DELIVERED orders older than ``days`` with their items and payments.

    One frozen clock for all three deletes.  The doomed set is a filter on
    orders; children drop by a left-anti join on its order ids.  Returns the
    three new tables and ``deleted_orders`` (the doomed order rows).
    """
    cutoff = as_timestamp(as_of) - _dt.timedelta(days=days)
    doomed_pred = F.col("status").isin(list(PURGE_STATUSES)) & (F.col("order_date") < lit_ts(cutoff))
    doomed = orders.where(doomed_pred)
    ids = doomed.select("order_id")
    return {
        "orders": orders.where(~doomed_pred | doomed_pred.isNull()),
        "order_items": items.join(ids, "order_id", "left_anti"),
        "transactions": txns.join(ids, "order_id", "left_anti"),
        "deleted_orders": doomed,
    }


# ----------------------------------------------------------------- B17-B18 sessions
def create_sessions(requests: DataFrame, as_of, seed: int = 0) -> DataFrame:
    """requests(request_id, customer_id[, user_agent]) -> active sessions.

    The session id is a UUID-formatted digest of (request, clock), so a task
    re-run after a lost executor produces the same ids.
    """
    h = F.md5(F.concat_ws("|", F.col("request_id").cast("string"), F.lit(str(as_timestamp(as_of))),
                          F.lit(str(seed))))
    sid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                      F.substring(h, 17, 4), F.substring(h, 21, 12))
    ua = F.col("user_agent") if "user_agent" in requests.columns else F.lit(None).cast("string")
    ip = F.concat(F.lit("192.168."), hash_int_between(1, 255, "request_id", seed=seed).cast("string"), F.lit("."),
                  hash_int_between(1, 255, "request_id", seed=seed + 1).cast("string"))
    return requests.select(sid.alias("session_id"), F.col("customer_id").cast("bigint").alias("customer_id"),
                           lit_ts(as_of).alias("login_time"), lit_ts(as_of).alias("last_activity"),
                           ip.alias("ip_address"), ua.alias("user_agent"),
                           F.lit(None).cast("string").alias("session_data"), F.lit(1).alias("is_active"))


def end_sessions(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """is_active = 0 for the listed session ids."""
    hit = ids.select("session_id").distinct().withColumn("_end", F.lit(True))
    return (sessions.join(hit, "session_id", "left")
            .withColumn("is_active", F.when(F.col("_end"), F.lit(0)).otherwise(F.col("is_active")))
            .select(*sessions.columns))
