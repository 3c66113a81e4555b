"""Stock reservation, batch form.

Semantics (per inventory row of the requested product, in request order):
if quantity_available >= q then available -= q, reserved += q, else the
request is refused and nothing changes.  A refused request must not count
against later ones, so this is a fold, not a running sum.

Exact distributed evaluation, without collecting a hot product's requests into
one task.  Only candidates are carried on: pending requests with
q <= available (larger ones can never be accepted later, since availability
only falls).

* An inventory row with at most ``FOLD_ROWS`` candidates is folded at once, in
  order, by one aggregate expression: one exchange for all ordinary products.
* Rows with more go through rounds.  Their requests are numbered once, in order,
  and cut into chunks of that number.  A round takes the running sum of the
  candidate quantities (chunk totals, then a window inside each chunk), accepts
  all candidates before the first that doesn't fit, and refuses that one;
  availability drops by what was accepted.  What follows is pending, and goes on
  to the fold as soon as few enough candidates are left.

Rounds: a refusal of q leaves less than q available, and larger requests are
no candidates from then on, so the largest pending quantity of an inventory
row falls strictly with each round.  There are at most (number of distinct
quantities + 1) rounds.  Each is written once to the shared checkpoint folder.

Negative quantities raise an error: they would give stock back, which is a
restock (B8).  A null quantity or seq, or a product without stock row, is
refused or has no decision, as a comparison with null fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_dir
from .ids import assign_ids

FOLD_ROWS = 1000


def running_sum(df: DataFrame, key: str, order_col: str, value_col: str, out_col: str,
                chunk: int = 1 << 16) -> DataFrame:
    """Inclusive running sum of ``value_col`` per ``key`` in ``order_col`` order.

    ``order_col`` must be a unique, integral order within ``key``.  Rows are
    cut into chunks of the order value; chunk totals (one row per key and
    chunk) give the offsets, the window runs inside each chunk only.
    """
    c = df.withColumn("_chunk", F.floor(F.col(order_col) / F.lit(chunk)))
    tot = c.groupBy(key, "_chunk").agg(F.sum(value_col).alias("_ct"))
    off = tot.select(key, "_chunk", F.coalesce(F.sum("_ct").over(
        Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    w = Window.partitionBy(key, "_chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (c.withColumn("_in", F.sum(value_col).over(w)).join(off, [key, "_chunk"])
            .withColumn(out_col, F.col("_in") + F.col("_off")).drop("_chunk", "_in", "_off"))


def _fold(pending: DataFrame) -> DataFrame:
    """Accepted (inventory_id, seq, quantity) of rows with few candidates, by an ordered fold."""
    line = F.struct("seq", "quantity")
    rows = pending.groupBy("inventory_id").agg(F.max("_avail").alias("_avail"), F.array_sort(F.collect_list(line)).alias("_lines"))
    start = F.struct(F.col("_avail").alias("left"), F.expr("array()").cast("array<struct<seq:bigint,quantity:bigint>>").alias("taken"))

    def step(acc, x):
        fits = x["quantity"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - x["quantity"]).otherwise(acc["left"]).alias("left"),
                        F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"))

    taken = F.aggregate("_lines", start, step, lambda acc: acc["taken"])
    return rows.select("inventory_id", F.inline(taken))


def reserve_inventory(inventory: DataFrame, requests: DataFrame, chunk: int = 1 << 16,
                      fold_rows: int = FOLD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Apply reservation requests (seq, product_id, quantity) to every inventory row of the product.

    Returns (inventory after, decisions(inventory_id, seq, product_id, quantity, accepted)).
    ``seq`` must be unique and integral (request order).
    """
    spark = inventory.sparkSession
    quantity = F.col("quantity").cast("bigint")
    quantity = F.when(quantity < 0, F.raise_error(F.concat(F.lit("negative quantity in request "), F.col("seq").cast("string")))
                      .cast("bigint")).otherwise(quantity)
    asked = (requests.select(F.col("seq").cast("bigint").alias("seq"), "product_id", quantity.alias("quantity"))
             .join(inventory.select("inventory_id", "product_id", F.col("quantity_available").alias("_avail")), "product_id"))
    root = scratch_dir(spark, "reserve")
    size = "_n"

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidates of inventory rows with few and with many of them."""
        cand = rows.where(F.col("quantity") <= F.col("_avail"))
        many = cand.groupBy("inventory_id").agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > fold_rows).select("inventory_id")
        many = materialize(many, "reserve-many")
        return cand.join(many, "inventory_id", "left_anti"), cand.join(many, "inventory_id", "left_semi")

    asked = materialize(asked, "reserve-asked")
    few, many = split(asked.where("seq IS NOT NULL").select("inventory_id", "seq", "quantity", "_avail"))
    _fold(few).write.parquet(f"{root}/fold=0")
    n = 0
    if not many.isEmpty():
        pending = materialize(assign_ids(many, ["inventory_id", "seq"], id_col="_nr", start=0), "reserve-hot")
        while True:
            cs = running_sum(pending, "inventory_id", "_nr", "quantity", "_cum", chunk)
            # quantities are not negative, so the sums rise: what fits comes before the first that doesn't
            fits = F.col("_cum") <= F.col("_avail")
            per_inv = cs.groupBy("inventory_id").agg(F.coalesce(F.max(F.when(fits, F.col("_cum"))), F.lit(0)).alias("_got"),
                                                     F.min(F.when(~fits, F.col("_nr"))).alias("_fail"))
            n += 1
            path = f"{root}-round/{n}"
            (cs.join(per_inv, "inventory_id")
             .select("inventory_id", "_nr", "seq", "quantity", (F.col("_avail") - F.col("_got")).alias("_avail"),
                     fits.alias("_accepted"), F.coalesce(F.col("_nr") > F.col("_fail"), F.lit(False)).alias("_pending"))
             .where("_accepted OR _pending").write.parquet(path))
            done = spark.read.parquet(path)
            # a row beyond the refused one is decided later, even if it would have fitted
            done.where("NOT _pending").select("inventory_id", "seq", "quantity").write.parquet(f"{root}/round={n}")
            few, pending = split(done.where("_pending").select("inventory_id", "_nr", "seq", "quantity", "_avail"))
            _fold(few).write.parquet(f"{root}/fold={n}")
            if pending.isEmpty():
                break
    schema = "inventory_id bigint, seq bigint, quantity bigint"
    accepted = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
    taken = accepted.groupBy("inventory_id").agg(F.sum("quantity").alias("_taken"))
    got = F.coalesce(F.col("_taken"), F.lit(0))
    after = (inventory.join(taken, "inventory_id", "left")
             .withColumn("quantity_available", F.col("quantity_available") - got)
             .withColumn("quantity_reserved", F.coalesce(F.col("quantity_reserved"), F.lit(0)) + got)
             .select(*inventory.columns))
    decisions = (asked.join(accepted.select("inventory_id", "seq", F.lit(True).alias("accepted")), ["inventory_id", "seq"], "left")
                 .select("inventory_id", "seq", "product_id", "quantity",
                         F.coalesce(F.col("accepted"), F.lit(False)).alias("accepted")))
    return after, decisions
