"""Frequent pairs of products over orders (the affinity report's engine).

Pairs of an order grow with the square of its size, so they are pruned before
they are shuffled, and a huge order is spread over tasks:

1. products in fewer than ``min_support`` orders can't be in a frequent pair;
2. an order's products are dealt by hash to blocks of about ``BLOCK``; a pair
   of blocks is the unit of work.  Ordinary orders have one block; the block
   pairs of larger ones get an exchange of their own, so that one order of
   thousands of lines is many small tasks;
3. pairs are counted twice: first by one of ``BINS`` hash bins (a table of
   fixed size, combined map-side), then exactly, and only pairs of bins that
   reach the support are shuffled.  A bin's count is never below a pair's, so
   nothing frequent is lost, however full the bins are.

The result is bounded by the support, not by the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 128
BINS = 1 << 20


def _blocks(kept: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(order_id, block, members) of orders of one block, and pairs of blocks (order_id, i, j, x, y) of the larger ones."""
    size = kept.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = kept.join(size, "order_id").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    small = sized.where("blocks = 1").groupBy("order_id").agg(F.collect_list("product_id").alias("x"))
    # a block holds about ``block`` products: the hash deals each of them on its own
    dealt = sized.where("blocks > 1").withColumn("i", F.pmod(F.xxhash64("product_id", "order_id"), F.col("blocks")).cast("int"))
    parts = dealt.groupBy("order_id", "blocks", "i").agg(F.collect_list("product_id").alias("x"))
    # each block is copied to the pairs it belongs to, which then meet by pair
    paired = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "order_id", F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"), F.struct("i", "x").alias("part"))
    met = paired.groupBy("order_id", "lo", "hi").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    return small, met.select("order_id", (F.col("lo") == F.col("hi")).alias("same"), (F.col("p.i") != F.col("q.i")).alias("two"),
                             F.col("p.x").alias("x"), F.col("q.x").alias("y"))


def candidate_pairs(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, once for each order that holds both."""
    small, large = _blocks(kept, block)
    inside = small.select(F.col("x"), F.explode("x").alias("p")).select("p", F.explode("x").alias("q")).where("p < q").select(
        F.col("p").alias("a"), F.col("q").alias("b"))
    wide = (large.where("same OR two").select("same", "y", F.explode("x").alias("p")).select("same", "p", F.explode("y").alias("q"))
            .where("p < q OR (p > q AND NOT same)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    return inside.unionByName(wide)


def frequent_pairs(items: DataFrame, min_support: int, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """product_a, product_b, together, orders_a and orders_b of the pairs in at least ``min_support`` orders.

    ``items`` holds order_id and product_id; repeated lines of an order count
    once, lines without either id not at all.
    """
    if min_support < 1:
        raise ValueError(f"min_support {min_support}")
    lines = items.where("order_id IS NOT NULL AND product_id IS NOT NULL").select("order_id", "product_id").distinct()
    lines = materialize(lines, "basket-lines")
    support = materialize(lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("orders")).where(F.col("orders") >= min_support),
                          "basket-support")
    kept = materialize(lines.join(support.select("product_id"), "product_id", "left_semi"), "basket-kept")
    pairs = candidate_pairs(kept, block)
    if min_support > 1:
        full = (pairs.groupBy(_bin(bins).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
                .select("bin"))
        # at most ``bins`` numbers
        pairs = pairs.withColumn("bin", _bin(bins)).join(F.broadcast(full), "bin", "left_semi").drop("bin")
    together = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= min_support)
    of = lambda c, n: support.select(F.col("product_id").alias(c), F.col("orders").alias(n))
    return (together.join(of("a", "orders_a"), "a").join(of("b", "orders_b"), "b")
            .select(F.col("a").alias("product_a"), F.col("b").alias("product_b"), "together", "orders_a", "orders_b"))


def _bin(bins: int) -> Column:
    return F.pmod(F.xxhash64("a", "b"), F.lit(bins)).cast("int")
