import tempfile
from decimal import Decimal

from ledgerline.sources.seeds import seed_customers, seed_inventory, seed_products
from ledgerline.sources.sinks import read_table, replace_table, reset_tables


def test_setup_seeds_closed_forms(spark):
    c = {r.customer_id: r for r in seed_customers(spark).collect()}
    assert len(c) == 1000
    assert c[10].customer_type == "PREMIUM" and c[11].customer_type == "REGULAR"
    assert c[7].phone == "555-0000007" and c[7].email == "customer7@example.com" and c[7].loyalty_points == 700
    p = {r.product_id: r for r in seed_products(spark).collect()}
    assert p[2].price == Decimal("22.99") and p[2].cost == Decimal("11.50") and p[2].sku == "SKU-00000002"
    i = {r.inventory_id: r for r in seed_inventory(spark).collect()}
    assert i[3].quantity_available == 1000 + (3 * 137) % 5000 and i[3].warehouse_location == "WH-3"


def test_random_seeds_repeatable_and_in_range(spark):
    a = seed_products(spark, variant="random", seed=7, as_of="2001-08-01 00:00:00").collect()
    b = seed_products(spark, variant="random", seed=7, as_of="2001-08-01 00:00:00").collect()
    assert a == b
    assert all(10 <= r.price < 500 and r.cost == r.price * Decimal("0.6") for r in a)


def test_reset_and_replace(spark):
    root = tempfile.mkdtemp(prefix="ledgerline-reset-")
    status = reset_tables(spark, root, variant="setup", as_of="2001-08-01 00:00:00")
    assert status["customers"] == "seeded" and status["orders"] == "truncated"
    assert read_table(spark, f"{root}/customers", "customers").count() == 1000
    cust = read_table(spark, f"{root}/customers", "customers")
    replace_table(cust.limit(3), f"{root}/customers")   # replaced while the old version was readable
    assert read_table(spark, f"{root}/customers", "customers").count() == 3


def test_clustered_layout_gives_disjoint_file_ranges(spark, tables):
    import glob

    import pyarrow.parquet as pq

    from ledgerline.sources.layout import CLUSTERING, write_clustered
    root = tempfile.mkdtemp(prefix="ledgerline-layout-")
    o = tables["orders"]
    write_clustered(o, f"{root}/orders", CLUSTERING["orders"], num_files=4)
    back = spark.read.parquet(f"{root}/orders")
    assert back.count() == o.count()
    ranges = []
    for f in sorted(glob.glob(f"{root}/orders/*.parquet")):
        vals = [v for v in pq.read_table(f, columns=["order_date"]).column(0).to_pylist() if v is not None]
        if vals:
            ranges.append((min(vals), max(vals)))
    ranges.sort()
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))  # files do not overlap in time


def test_stored_tables_end_to_end(spark):
    """Reset + seed stored tables, load them with the DDL schemas, run plans, place orders, persist."""
    from pyspark.sql import functions as F

    from ledgerline.operators.oltp import place_orders
    from ledgerline.plans.analytics import product_performance
    from ledgerline.sources.sinks import append_table, load_shop_tables
    root = tempfile.mkdtemp(prefix="ledgerline-store-")
    reset_tables(spark, root, variant="setup", as_of="2001-08-01 00:00:00")
    t = load_shop_tables(spark, root)
    perf = product_performance(t).collect()
    assert len(perf) == 500 and all(r.total_units_sold == 0 for r in perf)
    reqs = spark.createDataFrame([(1, 3, None)], "request_id bigint, customer_id bigint, payment_method string")
    lines = spark.createDataFrame([(1, 1, 2, 3)], "request_id bigint, line_no bigint, product_id bigint, quantity bigint")
    out = place_orders(t, reqs, lines, "2001-08-01 12:00:00")
    new_order = out["new_orders"].collect()[0]
    assert new_order.order_id == 1 and new_order.total_amount == Decimal("84.49")  # 68.97 + 5.5176 tax + 10 shipping
    append_table(out["new_orders"].select(*[F.col(c) for c in t["orders"].columns if c in out["new_orders"].columns]),
                 f"{root}/orders_new")
    assert spark.read.parquet(f"{root}/orders_new").count() == 1
    inv = {r.inventory_id: (r.quantity_available, r.quantity_reserved) for r in out["reserve"]()[0].collect()}
    assert inv[2] == (1000 + (2 * 137) % 5000 - 3, 3)


def test_purge_persisted_together(spark, tables):
    from pyspark.sql import functions as F

    from ledgerline.operators.oltp import purge_old_orders
    from ledgerline.sources.sinks import current_path, replace_tables
    root = tempfile.mkdtemp(prefix="ledgerline-purge-")
    names = ["orders", "order_items", "transactions"]
    for n in names:
        tables[n].write.parquet(f"{root}/{n}")
    cur = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    before = {n: cur[n].count() for n in names}
    out = purge_old_orders(cur["orders"], cur["order_items"], cur["transactions"], "2001-08-01 12:00:00")
    expect = {n: out[n].count() for n in names}
    replace_tables({n: out[n] for n in names}, root)     # reads and replaces the same folders
    after = {n: spark.read.parquet(current_path(spark, f"{root}/{n}")).count() for n in names}
    assert after == expect and all(after[n] < before[n] for n in names)
    gone = spark.read.parquet(current_path(spark, f"{root}/orders")).where(F.col("status") == "COMPLETED").agg(F.min("order_date")).first()[0]
    assert gone is None or str(gone) >= "2001-05-03"


def test_materialize_and_clear_stage(spark):
    """clear_stage removes this application's folders and leaves another application's alone."""
    import os

    from ledgerline.session import STAGE_FOLDER, clear_stage, ensure_checkpoint_dir, materialize, stage_root
    df = materialize(spark.range(5).toDF("v"))
    assert df.count() == 5
    base = ensure_checkpoint_dir(spark)
    own = stage_root(spark)
    assert os.path.isdir(own) and own.startswith(os.path.join(base, STAGE_FOLDER))
    other = os.path.join(base, STAGE_FOLDER, "app-of-someone-else", "stage-1")
    os.makedirs(other, exist_ok=True)
    clear_stage(spark)
    assert not os.path.exists(own)
    assert os.path.isdir(other)


def test_load_tables_sees_appended_files(spark, tmp_path):
    import os
    import shutil

    from ledgerline.sources import load_tables
    root = str(tmp_path / "data")
    os.makedirs(root)
    for name in os.listdir("/root/testdata/sf0.001"):  # file by file: the folder's own mode may be read-only
        shutil.copyfile(f"/root/testdata/sf0.001/{name}", f"{root}/{name}")
    spark.read.parquet(f"{root}/orders.parquet").limit(100).write.parquet(f"{root}/more")
    n = load_tables(spark, root)["orders"].count()
    raw = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    raw.limit(100).write.mode("append").parquet(f"{root}/orders2.parquet")
    raw.write.mode("append").parquet(f"{root}/orders2.parquet")
    os.replace(f"{root}/orders.parquet", f"{root}/orders_single.parquet")
    os.rename(f"{root}/orders2.parquet", f"{root}/orders.parquet")
    assert load_tables(spark, root)["orders"].count() == n + 100


def test_failed_publish_leaves_old_versions(spark, tmp_path, monkeypatch):
    import pytest

    from ledgerline.sources import sinks
    root = str(tmp_path / "store")
    sinks.replace_tables({"a": spark.range(3), "b": spark.range(4)}, root)
    def fail(*_):
        raise OSError("lost")
    monkeypatch.setattr(sinks, "_publish", fail)
    with pytest.raises(OSError):
        sinks.replace_tables({"a": spark.range(30), "b": spark.range(40)}, root)
    n = [spark.read.parquet(sinks.current_path(spark, f"{root}/{x}")).count() for x in "ab"]
    assert n == [3, 4]
    monkeypatch.undo()
    for k in (5, 6, 7):
        sinks.replace_table(spark.range(k), f"{root}/a")
    assert spark.read.parquet(sinks.current_path(spark, f"{root}/a")).count() == 7
    assert len([x for x in (tmp_path / "store" / "a").iterdir() if x.name.startswith("version-")]) == 2
