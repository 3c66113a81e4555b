"""Daily sketches: any range within the error bound of the exact count, months replaced one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import sketches as S
from ledgerline.sources.partitions import manifest


@pytest.fixture(scope="module")
def busy(spark):
    """200,000 orders over 120 days by about 50,000 customers, a third of them by one."""
    start = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    customer = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000)))
    return spark.range(200_000).select(
        customer.alias("customer_id"), (start + F.make_dt_interval(days=(F.col("id") % 120).cast("int"))).alias("order_date"))


@pytest.mark.parametrize("first,last", [("2001-01-01", "2001-04-30"), ("2001-01-05", "2001-01-05"), ("2001-01-20", "2001-02-03"),
                                        ("2001-02-01", "2001-02-28"), ("2010-01-01", "2010-02-01")])
def test_ranges_within_the_bound(busy, first, last):
    got = S.customers_between(S.daily_sketches(busy), first, last).first()
    day = F.to_date("order_date")
    exact = busy.where((day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date")))
    n = exact.select("customer_id").distinct().count()
    assert got["orders"] == exact.count() and abs(got["customers"] - n) <= max(1, 3 * S.RELATIVE_ERROR * n)


def test_a_month_is_replaced_alone(spark, busy, tmp_path):
    path = str(tmp_path / "daily")
    assert S.store_sketches(spark, path, busy) == ["2001-01", "2001-02", "2001-03", "2001-04"]
    before = manifest(spark, path)
    more = busy.unionByName(spark.createDataFrame([(10 ** 9, dt.datetime(2001, 4, 2)), (None, dt.datetime(2001, 4, 2)), (5, None)],
                                                  "customer_id long, order_date timestamp_ntz"))
    S.store_sketches(spark, path, more, ["2001-04"])
    after = manifest(spark, path)
    assert {m for m in after if after[m] != before[m]} == {"2001-04"}
    assert S.customers_between(S.read_sketches(spark, path), "2001-01-01", "2001-12-31").first()["orders"] == 200_001
    assert S.daily_sketches(busy.limit(0)).count() == 0


def test_stream_counts_distinct_orders_in_update_mode(spark, tmp_path):
    from ledgerline.streaming import ORDER_STREAM_SCHEMA, daily_totals_stream, read_order_stream
    rows = spark.range(3000).select(F.col("id").alias("order_id"), F.lit(1).cast("long").alias("customer_id"),
                                    F.lit("2001-07-01 10:00:00").cast("timestamp_ntz").alias("order_date"), F.lit("SHIPPED").alias("status"),
                                    F.lit(1).cast("decimal(12,2)").alias("total_amount"), F.lit("CARD").alias("payment_method"))
    assert rows.schema.simpleString() == spark.createDataFrame([], ORDER_STREAM_SCHEMA).schema.simpleString()
    for k in range(2):  # every order delivered twice
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    q = (daily_totals_stream(read_order_stream(spark, f"{tmp_path}/in/*", max_files=1), distinct=True).writeStream.outputMode("update")
         .format("memory").queryName("ll_t2d2").option("checkpointLocation", f"{tmp_path}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT max(total_orders) n, max_by(distinct_orders, total_orders) d FROM ll_t2d2").first()
    assert last["n"] == 6000 and abs(last["d"] - 3000) <= 0.03 * 3000
