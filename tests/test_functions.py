import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions import (add_months_col, add_months_sticky, month_index, month_label_from_index,
                                  concat_null_as_empty, order_desc)


def test_add_months_sticky_rules():
    assert add_months_sticky("2024-02-29 10:30:00", 1) == dt.datetime(2024, 3, 31, 10, 30)
    assert add_months_sticky("2024-01-31 00:00:00", 1) == dt.datetime(2024, 2, 29)
    assert add_months_sticky("2024-03-15 08:00:00", -1) == dt.datetime(2024, 2, 15, 8)
    assert add_months_sticky("2001-08-01 12:00:00", -24) == dt.datetime(1999, 8, 1, 12)
    assert add_months_sticky("2023-01-30 00:00:00", 1) == dt.datetime(2023, 2, 28)


def test_add_months_col_matches_python(spark):
    vals = ["2024-02-29 10:30:00", "2024-01-31 00:00:00", "2024-03-15 08:00:00", "2023-01-30 23:59:59"]
    df = spark.createDataFrame([(v,) for v in vals], "s string").select(
        F.to_timestamp_ntz("s").alias("ts"))
    for n in (1, -1, 13):
        got = [r[0] for r in df.select(add_months_col(F.col("ts"), n)).collect()]
        assert got == [add_months_sticky(v, n) for v in vals]


def test_concat_null_is_empty(spark):
    df = spark.createDataFrame([(None, "X"), ("A", None)], "a string, b string")
    assert [r[0] for r in df.select(concat_null_as_empty("a", F.lit(" "), "b")).collect()] == [" X", "A "]


def test_desc_nulls_first(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r[0] for r in df.orderBy(order_desc("x")).collect()] == [None, 3, 1]


def test_month_index_roundtrip(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 8, 1),), (dt.datetime(1999, 12, 31),)], "ts timestamp_ntz")
    got = [r[0] for r in df.select(month_label_from_index(month_index(F.col("ts")))).collect()]
    assert got == ["2001-08", "1999-12"]
