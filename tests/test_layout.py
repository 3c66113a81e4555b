"""Storage layouts: lookups read a small share of the row groups, co-located joins need no exchange."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import analytics as A
from ledgerline.sources import layout


@pytest.fixture(scope="module")
def wide(spark):
    """200,000 rows with scattered keys, clustered by another column."""
    return spark.range(200_000).select(((F.col("id") * 7_919_111) % 99_999_989).alias("k"), F.col("id").alias("v"),
                                       F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def rows_read(df):
    """Rows that the scans of a collected plan yielded (row groups skipped are not read)."""
    def leaves(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return leaves(p.executedPlan())
        if name.startswith("Scan parquet"):
            return p.metrics().apply("numOutputRows").value()
        if name.endswith("QueryStage"):
            return leaves(p.plan())
        kids = p.children()
        return sum(leaves(kids.apply(i)) for i in range(kids.size()))
    df.collect()
    return leaves(df._jdf.queryExecution().executedPlan())


def test_lookup_of_random_keys_reads_few_row_groups(spark, wide, tmp_path):
    path = str(tmp_path / "t")
    layout.write_clustered(wide, path, ["v"], 8, key_filters=["k"], row_group_bytes=64 << 10)
    plain = str(tmp_path / "plain")
    layout.write_clustered(wide, plain, ["v"], 8, row_group_bytes=64 << 10)
    ids = random.Random(1).sample(range(200_000), 20)
    keys = spark.createDataFrame([(i * 7_919_111 % 99_999_989,) for i in ids] + [(-5,), (None,)], "k long")
    got = layout.lookup_keys(spark, path, wide.schema, "k", keys)
    assert sorted(r["v"] for r in got.collect()) == sorted(ids)
    read, without = rows_read(got), rows_read(layout.lookup_keys(spark, plain, wide.schema, "k", keys))
    assert read < 0.35 * 200_000 and without == 200_000, (read, without)
    # by the clustering column, its statistics alone do
    by_v = layout.lookup_keys(spark, plain, wide.schema, "v", spark.createDataFrame([(ids[0],), (ids[1],)], "v long"))
    assert sorted(r["v"] for r in by_v.collect()) == sorted(ids[:2]) and rows_read(by_v) < 0.1 * 200_000


def test_many_and_no_keys(spark, wide, tmp_path):
    path = str(tmp_path / "t")
    layout.write_clustered(wide, path, ["v"], 4, key_filters=["k"])
    many = wide.where("v % 100 = 3").select("k")
    assert layout.lookup_keys(spark, path, wide.schema, "k", many.union(many)).count() == 2000
    assert layout.lookup_keys(spark, path, wide.schema, "k", many.limit(0)).count() == 0


def test_colocated_joins_have_no_exchange(spark, tables, tmp_path):
    names = ("orders", "order_items", "transactions")
    schemas = {n: tables[n].schema for n in names}
    root, db = str(tmp_path / "shop"), "ledgerline_layout_test"
    layout.write_colocated({n: tables[n] for n in names}, root, db, 8)
    try:
        spark.sql(f"DROP TABLE `{db}`.orders")  # as in a new session
        t = layout.open_colocated(spark, schemas, root, db, 8)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = (t["orders"].join(t["order_items"], "order_id").join(t["transactions"].withColumnRenamed("status", "paid"), "order_id", "left")
                      .groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("subtotal").alias("s")))
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
            direct = (tables["orders"].join(tables["order_items"], "order_id").join(tables["transactions"].select("order_id"), "order_id", "left")
                      .groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("subtotal").alias("s")))
            assert joined.exceptAll(direct).count() == 0 and joined.count() == direct.count()
            # daily sales over the co-located tables: only the aggregate by day is shuffled
            daily = A.daily_sales({**tables, **t})
            assert daily._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1
            assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, A.daily_sales(tables).collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    finally:
        spark.sql(f"DROP DATABASE `{db}` CASCADE")
