"""Stored tables of which single partitions are replaced: merges, purges, repeatable appends, placement."""

import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.audit import audit_changes
from ledgerline.operators.upsert import upsert_changes
from ledgerline.plans import stored
from ledgerline.plans.warehouse import merge_stored_summary
from ledgerline.schema import SCHEMAS
from ledgerline.sources import partitions as P

SUMMARY = SCHEMAS["sales_summary"]


def files(root):
    """Every data file under a folder with its time of change."""
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(root)
            for n in names if n.endswith(".parquet")}


def summary(spark, path):
    return sorted((r["summary_id"], r["summary_date"], r["total_orders"], r["total_revenue"])
                  for r in P.read_partitions(spark, path, SUMMARY).collect())


def days(spark, rows):
    return spark.createDataFrame([(d, n, Decimal(v)) for d, n, v in rows],
                                 "summary_date date, total_orders long, total_revenue decimal(15,2)")


def merge(spark, path, rows):
    return sorted((r["operation"], r["new"]["summary_date"], r["old"] and r["old"]["total_orders"], r["new"]["total_orders"])
                  for r in P.merge_partitions(spark, path, "sales_summary", days(spark, rows), P.month_of, "summary_date",
                                              ["summary_date"], ["total_orders", "total_revenue"], "summary_id").collect())


def test_merge_of_one_day_leaves_other_months_files(spark, tmp_path):
    path = str(tmp_path / "sales_summary")
    year = [(dt.date(2001, m, 5), m, f"{m}.50") for m in range(1, 13)]
    assert len(merge(spark, path, year)) == 12
    before = files(path)
    d = dt.date
    assert merge(spark, path, [(d(2001, 3, 5), 33, "1.00"), (d(2001, 3, 6), 1, "2.00")]) == [
        ("INSERT", d(2001, 3, 6), None, 1), ("UPDATE", d(2001, 3, 5), 3, 33)]
    after = files(path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert len(before) == 12 and kept == set(before)           # nothing is overwritten; readers of the old version go on
    assert len(set(after) - set(before)) == 1 and all("2001-03" in f for f in set(after) - set(before))
    got = summary(spark, path)
    assert [r[0] for r in got] == list(range(1, 14)) and got[12][1:] == (d(2001, 3, 6), 1, Decimal("2.00"))
    assert next(r for r in got if r[1] == d(2001, 3, 5))[2:] == (33, Decimal("1.00"))
    # a merge that changes nothing writes nothing
    before = files(path)
    assert merge(spark, path, [(d(2001, 3, 6), 1, "2.00")]) == [] and files(path) == before
    # only the touched partition's files are read
    march = P.read_partitions(spark, path, SUMMARY, ["2001-03"])
    assert march.count() == 2 and all("part=2001-03" in f for f in march.inputFiles())


def test_versions_no_partition_needs_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    one = lambda v: spark.createDataFrame([(v,)], "v long").withColumn("part", F.lit("a"))
    for k in range(5):
        P.replace_partitions(str(tmp_path), {"t": (one(k), ["a"])})
    assert P.read_partitions(spark, path, "v long").first()[0] == 4
    assert len([n for n in os.listdir(path) if n.startswith("version-")]) == 2  # the current one and the one before


def test_emptied_and_odd_partitions(spark, tmp_path):
    root, path = str(tmp_path), str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v long, part string")
    P.write_partitioned(rows.drop("part"), path, F.when(F.col("v") == 1, "a").otherwise("b"))
    P.replace_partitions(root, {"t": (rows.where("false"), ["a"])})
    assert [tuple(r) for r in P.read_partitions(spark, path, "v long", with_part=True).collect()] == [(2, "b")]
    with pytest.raises(ValueError):
        P.replace_partitions(root, {"t": (rows, ["a"])})       # rows outside the stated partitions
    with pytest.raises(ValueError):
        P.replace_partitions(root, {"t": (rows, ["a/b"])})
    assert [r[0] for r in P.read_partitions(spark, path, "v long").collect()] == [2]
    assert P.read_partitions(spark, str(tmp_path / "none"), "v long", with_part=True).count() == 0


def test_a_batch_run_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "payments")
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "order_id long")
    for _ in range(2):
        P.append_batch(batch(30, 10, 20), path, "monday", "id", ["order_id"])
    P.append_batch(batch(5), path, "tuesday", "id", ["order_id"])
    P.append_batch(batch(20, 30, 10), path, "monday", "id", ["order_id"])
    rows = lambda: sorted(map(tuple, P.read_partitions(spark, path, "order_id long, id long").collect()))
    assert rows() == [(5, 4), (10, 1), (20, 2), (30, 3)]
    P.append_batch(batch(10, 20), path, "monday", "id", ["order_id"])       # fewer rows: new ids, no clash
    assert rows() == [(5, 4), (10, 5), (20, 6)]
    P.append_batch(batch(), path, "tuesday", "id", ["order_id"])
    assert rows() == [(10, 5), (20, 6)]


def test_a_failed_append_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    P.append_batch(spark.range(3), path, "a")
    def fail(*_, **__):
        raise OSError("lost")
    monkeypatch.setattr(P, "_publish", fail)
    with pytest.raises(OSError):
        P.append_batch(spark.range(100), path, "a")
    monkeypatch.undo()
    assert P.read_partitions(spark, path, "id long").count() == 3


def test_change_feed_and_its_audit_rows(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 30)], "id long, k string, v long")
    source = spark.createDataFrame([("a", 10), ("b", 20), ("d", 40), (None, 50)], "k string, v long")
    merged, changes = upsert_changes(target, source, ["k"], ["v"], id_col="id")
    got = sorted(map(tuple, merged.collect()), key=repr)
    assert {r[1:] for r in got} == {("a", 10), ("b", 20), ("c", 30), ("d", 40), (None, 50)}
    feed = sorted((r["operation"], r["new"]["k"], r["old"] and r["old"]["v"], r["new"]["v"]) for r in changes.collect() if r["new"]["k"])
    assert feed == [("INSERT", "d", None, 40), ("UPDATE", "b", None, 20)] and changes.count() == 3
    audit = audit_changes(changes, "id", "T", as_of="2001-08-01 12:00:00").collect()
    assert sorted(r["audit_id"] for r in audit) == [1, 2, 3]
    by = {json.loads(r["new_value"]).get("k"): r for r in audit}
    assert by["b"]["operation"] == "UPDATE" and by["b"]["record_id"] == 2 and json.loads(by["b"]["old_value"]) == {"k": "b"}
    assert by["d"]["old_value"] is None


def test_stored_rollup_equals_the_table_merge(spark, tables, tmp_path):
    from ledgerline.plans.warehouse import merge_sales_summary_twice
    path = str(tmp_path / "sales_summary")
    for at in (dt.datetime(2001, 7, 29, 12), "2001-08-01 12:00:00"):
        merge_stored_summary(spark, path, tables, at)
    want = sorted((r["summary_id"], r["summary_date"], r["total_orders"], r["total_revenue"])
                  for r in merge_sales_summary_twice(tables).collect())
    assert summary(spark, path) == want


def test_purge_replaces_months_with_doomed_orders_only(spark, tables, tmp_path):
    root = str(tmp_path)
    month = tables["orders"].select("order_id", P.month_of("order_date").alias("part"))
    names = ("orders", "order_items", "transactions")
    for n in names:
        P.write_partitioned(tables[n].join(month, "order_id"), f"{root}/{n}", F.col("part"))
    before = {n: P.manifest(spark, f"{root}/{n}") for n in names}
    schemas = {n: tables[n].schema for n in names}
    n = stored.purge_stored(spark, root, schemas, "2001-08-01 12:00:00")
    gone = tables["orders"].where("status IN ('COMPLETED', 'DELIVERED') AND order_date < TIMESTAMP_NTZ '2001-05-03 12:00:00'")
    assert n == gone.count() > 0
    for name in names:
        left = P.read_partitions(spark, f"{root}/{name}", schemas[name])
        want = tables[name].join(gone.select("order_id"), "order_id", "left_anti")
        assert left.select(*sorted(want.columns)).exceptAll(want.select(*sorted(want.columns))).count() == 0
        assert left.count() == want.count()
        after = P.manifest(spark, f"{root}/{name}")
        assert all(after[m] == x for m, x in before[name].items() if m > "2001-05")
    assert stored.purge_stored(spark, root, schemas, "2001-08-01 12:00:00") == 0


def test_placement_is_one_transaction_that_may_be_repeated(spark, tmp_path):
    from ledgerline.sources.sinks import _pointers
    root = str(tmp_path)
    schemas = {n: SCHEMAS[n] for n in ("orders", "order_items", "inventory", "transactions")}
    products = spark.createDataFrame([(1, Decimal("10.00")), (2, Decimal("60.00"))], "product_id long, price decimal(10,2)")
    stock = spark.createDataFrame([(1, 1, "A", 10, 0), (2, 2, "A", 1, 0), (3, 3, "A", 7, 0)],
                                  "inventory_id long, product_id long, warehouse_location string, quantity_available long, quantity_reserved long")
    stock = stock.select(*[(F.col(f.name) if f.name in stock.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["inventory"]])
    P.write_partitioned(stock, f"{root}/inventory", stored.stock_bucket())
    untouched = {v: x for v, x in P.manifest(spark, f"{root}/inventory").items()
                 if v == P.touched(spark.createDataFrame([(3,)], "product_id long"), stored.stock_bucket())[0]}

    def place(batch, reqs, lines):
        r = spark.createDataFrame(reqs, "request_id long, customer_id long, payment_method string")
        i = spark.createDataFrame(lines, "request_id long, line_no long, product_id long, quantity long")
        return stored.place_orders_stored(spark, root, schemas, products, r, i, batch, "2001-08-01 12:00:00")

    first = [(7, 70, "PAYPAL"), (8, 80, None)], [(7, 1, 1, 4), (7, 2, 2, 2), (8, 3, 1, 6)]
    assert place("a", *first) == 2 and place("a", *first) == 0 and place("b", *first) == 0
    # a batch that overlaps: only the new request is placed, and the stock left refuses part of it
    assert place("a", [(8, 80, None), (9, 90, None)], [(8, 1, 1, 6), (9, 2, 1, 1), (9, 3, 2, 1)]) == 1
    read = lambda n: P.read_partitions(spark, f"{root}/{n}", SCHEMAS[n])
    orders = {r["order_id"]: r for r in read("orders").collect()}
    assert sorted(orders) == [1, 2, 3] and [orders[k]["customer_id"] for k in (1, 2, 3)] == [70, 80, 90]
    assert orders[1]["total_amount"] == Decimal("172.80") and orders[3]["payment_method"] == "CREDIT_CARD"
    assert sorted(r["order_id"] for r in read("transactions").collect()) == [1, 2, 3]
    assert sorted(r["order_item_id"] for r in read("order_items").collect()) == [1, 2, 3, 4, 5]
    left = {r["product_id"]: (r["quantity_available"], r["quantity_reserved"]) for r in read("inventory").collect()}
    assert left == {1: (0, 10), 2: (0, 1), 3: (7, 0)}
    assert untouched.items() <= P.manifest(spark, f"{root}/inventory").items()
    assert {"orders", "order_items", "transactions", "inventory", "placed_requests"} <= set(_pointers(spark, root))
