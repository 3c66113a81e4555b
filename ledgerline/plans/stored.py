"""Order-management jobs on stored, partitioned tables: each is one publication of all the tables it changes.

Both read and write only the partitions they touch (:mod:`ledgerline.sources.partitions`).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_timestamp
from ..operators import oltp
from ..session import materialize
from ..sources.partitions import PART, manifest, month_of, read_partitions, replace_partitions, touched

#: Partitions of the stored inventory; a batch of orders rewrites those of the products it asks for.
STOCK_BUCKETS = 64
PLACED = "request_id bigint, order_id bigint"


def stock_bucket(column: str = "product_id") -> Column:
    return F.concat(F.lit("b"), F.coalesce(F.pmod(F.xxhash64(column), F.lit(STOCK_BUCKETS)), F.lit(0)).cast("string"))


def purge_stored(spark: SparkSession, root: str, schemas: dict, as_of, days: int = 90) -> int:
    """B14 on stored tables orders, order_items and transactions, all partitioned by the order's month.

    Months with doomed orders are replaced, in the three tables together;
    other files stay.  Returns the number of deleted orders.
    """
    cutoff = as_timestamp(as_of) - _dt.timedelta(days=days)
    # later months hold nothing to delete, nor do rows without a date
    old = [v for v in manifest(spark, f"{root}/orders") if v <= cutoff.strftime("%Y-%m")]
    stored = read_partitions(spark, f"{root}/orders", schemas["orders"], old)
    doomed = materialize(oltp.purge_old_orders(stored, stored, stored, as_of, days)["deleted_orders"].select(
        "order_id", month_of("order_date").alias(PART)), "purge-doomed")
    months = touched(doomed, F.col(PART))
    if not months:
        return 0
    ids = doomed.select("order_id")
    replace_partitions(root, {
        name: (read_partitions(spark, f"{root}/{name}", schemas[name], months, with_part=True).join(ids, "order_id", "left_anti"), months)
        for name in ("orders", "order_items", "transactions")})
    return doomed.count()


def place_orders_stored(spark: SparkSession, root: str, schemas: dict, products: DataFrame, requests: DataFrame,
                        lines: DataFrame, batch: str, as_of) -> int:
    """B13 as one stored transaction; returns the number of orders placed.

    ``requests`` (request_id, customer_id[, payment_method]) that were placed
    before, in this batch or any other, are left out by their request_id, so a
    batch may be repeated or overlap another.  New orders, items and payments
    are partitions named after the batch; orders, items, payments, stock and
    the placed requests are published together.  (A job that dies before that
    leaves all five as they were.)
    """
    placed = read_partitions(spark, f"{root}/placed_requests", PLACED)
    # of a request given twice in a batch, one row
    fresh = requests.dropDuplicates(["request_id"]).join(placed.select("request_id"), "request_id", "left_anti")
    fresh = materialize(fresh, "placing-requests")
    n = fresh.count()
    if not n:
        return 0
    lines = lines.join(fresh.select("request_id"), "request_id", "left_semi")
    buckets = touched(lines.select("product_id"), stock_bucket())
    tables = {name: read_partitions(spark, f"{root}/{name}", schemas[name], buckets if name == "inventory" else None)
              for name in ("orders", "order_items", "inventory", "transactions")}
    out = oltp.place_orders({**tables, "products": products}, fresh, lines, as_of)
    new_orders = materialize(out["new_orders"], "placing-orders")
    stock, _ = out["reserve"]()
    part = f"batch-{batch}"
    if part in manifest(spark, f"{root}/orders"):
        part = f"{part}.{len(manifest(spark, f'{root}/orders'))}"

    def added(rows: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas[name].fields]
        return rows.select(*cols, F.lit(part).alias(PART)), [part]

    replace_partitions(root, {
        "orders": added(new_orders, "orders"), "order_items": added(out["new_items"], "order_items"),
        "transactions": added(out["new_transactions"], "transactions"),
        "placed_requests": (new_orders.select("request_id", "order_id", F.lit(part).alias(PART)), [part]),
        **({"inventory": (stock.withColumn(PART, stock_bucket()), buckets)} if buckets else {})})
    return n
