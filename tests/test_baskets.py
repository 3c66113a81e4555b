"""Frequent product pairs against brute force, with a huge order and hot products."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import baskets


def brute(rows, min_support):
    orders = collections.defaultdict(set)
    for o, p in rows:
        if o is not None and p is not None:
            orders[o].add(p)
    n, pairs = collections.Counter(), collections.Counter()
    for ps in orders.values():
        n.update(ps)
        pairs.update(itertools.combinations(sorted(ps), 2))
    return sorted((a, b, k, n[a], n[b]) for (a, b), k in pairs.items() if k >= min_support)


def found(df, *args, **kw):
    return sorted(map(tuple, baskets.frequent_pairs(df, *args, **kw).collect()))


@pytest.mark.parametrize("min_support,block,bins", [(1, 128, 1024), (2, 128, 1 << 20), (2, 3, 7), (3, 2, 1), (5, 4, 64), (50, 128, 1024)])
def test_against_brute_force(spark, min_support, block, bins):
    rng = random.Random(min_support * 31 + block)
    rows = [(o, rng.choice([1, 2, rng.randrange(30), rng.randrange(400)])) for o in range(200) for _ in range(rng.randrange(1, 20))]
    rows += rows[:50] + [(None, 1), (3, None), (900, 5), (901, None)]
    df = spark.createDataFrame(rows, "order_id long, product_id long").withColumn("x", F.lit("extra"))
    assert found(df, min_support, block=block, bins=bins) == brute(rows, min_support)


def test_an_order_of_five_thousand_products(spark):
    """The huge order meets two ordinary ones; its twelve million pairs are spread over block pairs."""
    rows = [(1, p) for p in range(5000)] + [(2, 10), (2, 4000), (2, 4999), (3, 10), (3, 4000)] + [(o, 7) for o in range(4, 60)]
    df = spark.createDataFrame(rows, "order_id long, product_id long")
    assert found(df, 2) == brute(rows, 2) == [(10, 4000, 3, 3, 3), (10, 4999, 2, 3, 2), (4000, 4999, 2, 3, 2)]
    _, large = baskets._blocks(df, 128)
    sizes = large.select(F.size("x").alias("x"), F.size("y").alias("y")).collect()
    assert len(sizes) == 40 * 41 // 2 and max(max(r) for r in sizes) < 3 * 128


def test_two_huge_orders_are_frequent_everywhere(spark):
    rows = [(o, p) for o in (1, 2) for p in range(300)]
    got = found(spark.createDataFrame(rows, "order_id long, product_id long"), 2, block=32, bins=16)
    assert len(got) == 300 * 299 // 2 and all(r[2:] == (2, 2, 2) for r in got)


def test_empty_and_bad_arguments(spark):
    df = spark.createDataFrame([], "order_id long, product_id long")
    assert found(df, 2) == []
    with pytest.raises(ValueError):
        baskets.frequent_pairs(df, 0)
