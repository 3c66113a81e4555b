"""Operators on small hand-made frames (FIXTURES.md §3) and brute-force checks."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import oltp as B
from ledgerline.operators.audit import audit_diff
from ledgerline.operators.constraints import constraint_report, constraint_violations
from ledgerline.operators.defaults import apply_defaults
from ledgerline.operators.ids import assign_ids
from brute import fold_reservations

from ledgerline.operators.reserve import reserve_inventory
from ledgerline.operators.upsert import MergeError, upsert
from ledgerline.plans.warehouse import empty_table, merge_sales_summary
from ledgerline.schema import SCHEMAS

AS_OF = "2001-08-01 12:00:00"


def _inv(spark, rows):
    return spark.createDataFrame(rows, "inventory_id bigint, product_id bigint, quantity_available bigint, "
                                       "quantity_reserved bigint")


def test_reserve_refused_request_does_not_count(spark):
    inv = _inv(spark, [(1, 100, 10, 0)])
    req = spark.createDataFrame([(1, 100, 7), (2, 100, 5), (3, 100, 3)], "seq bigint, product_id bigint, quantity bigint")
    after, dec = reserve_inventory(inv, req)
    r = after.collect()[0]
    assert (r.quantity_available, r.quantity_reserved) == (0, 10)
    assert [d.accepted for d in dec.orderBy("seq").collect()] == [True, False, True]


def test_reserve_every_warehouse_row_and_unknown_product(spark):
    inv = _inv(spark, [(1, 100, 10, 0), (2, 100, 4, 1), (3, 200, 5, 0)])
    req = spark.createDataFrame([(1, 100, 5), (2, 100, 4), (3, 999, 1)], "seq bigint, product_id bigint, quantity bigint")
    after, _ = reserve_inventory(inv, req)
    got = {r.inventory_id: (r.quantity_available, r.quantity_reserved) for r in after.collect()}
    assert got == {1: (1, 9), 2: (0, 5), 3: (5, 0)}


def test_reserve_rounds_equal_fold_on_derived_requests(spark, tables):
    """Brute force: the distributed rounds equal the literal ordered fold, with stock
    shrunk so that many requests are refused (small chunk forces the two-level sum)."""
    inv = tables["inventory"].select("inventory_id", "product_id",
                                     (F.col("quantity_available") % 60).alias("quantity_available"),
                                     "quantity_reserved")
    items = tables["order_items"]
    req = assign_ids(items.select("order_id", "product_id", "quantity"), ["order_id", "product_id", "quantity"],
                     id_col="seq").select("seq", "product_id", "quantity")
    after, dec = reserve_inventory(inv, req, chunk=3)
    fold = fold_reservations(inv, req)
    assert {r["inventory_id"]: (r["quantity_available"], r["quantity_reserved"]) for r in after.collect()} == {
        k: v[:2] for k, v in fold.items()}
    took = {}
    for r in dec.where("accepted").collect():
        took.setdefault(r["inventory_id"], set()).add(r["seq"])
    assert took == {k: v[2] for k, v in fold.items() if v[2]}
    assert dec.where(~F.col("accepted")).count() > 0


def test_reserve_rounds_are_bounded_by_distinct_quantities(spark, monkeypatch):
    """Requests made to alternate 1 and the whole remaining stock: many refusals, each in a round of its own."""
    from ledgerline.operators import reserve
    rounds = []
    real = reserve.running_sum
    monkeypatch.setattr(reserve, "running_sum", lambda *a: rounds.append(1) or real(*a))
    inv = _inv(spark, [(1, 7, 9, 0)])
    q = [x for k in range(9, 4, -1) for x in (1, k)]
    req = spark.createDataFrame([(i, 7, x) for i, x in enumerate(q, 1)], "seq bigint, product_id bigint, quantity bigint")
    after, _ = reserve_inventory(inv, req)
    fold = fold_reservations(inv, req)
    assert tuple(after.first())[2:4] == fold[1][:2]
    assert len(rounds) <= len(set(q)) + 1


@pytest.mark.parametrize("fold_rows", [0, 1, 7, 40])
def test_reserve_rounds_and_folds_agree_with_the_fold(spark, fold_rows):
    """Rows of every size on both ways: many rounds, rows that turn from rounds to the fold, and folds alone."""
    import random
    rng = random.Random(fold_rows)
    inv = _inv(spark, [(i, i % 6, rng.choice([0, 1, 9, 30, 300]), 0) for i in range(1, 15)])
    rows = [(s, rng.choice([0, 1, 2, 3, 3, 5, 7]), rng.choice([0, 1, 2, 5, 8, 13, 29])) for s in rng.sample(range(10 ** 9), 400)]
    req = spark.createDataFrame(rows, "seq bigint, product_id bigint, quantity bigint")
    after, dec = reserve_inventory(inv, req, chunk=5, fold_rows=fold_rows)
    fold = fold_reservations(inv, req)
    assert {r["inventory_id"]: (r["quantity_available"], r["quantity_reserved"]) for r in after.collect()} == {
        k: v[:2] for k, v in fold.items()}
    took = {}
    for r in dec.where("accepted").collect():
        took.setdefault(r["inventory_id"], set()).add(r["seq"])
    assert took == {k: v[2] for k, v in fold.items() if v[2]}
    assert dec.count() == sum(r[1] == i["product_id"] for r in rows for i in inv.collect())


def test_reserve_refuses_negative_and_null_quantities(spark):
    inv = _inv(spark, [(1, 7, 10, 0)])
    schema = "seq bigint, product_id bigint, quantity bigint"
    with pytest.raises(Exception, match="negative quantity in request 2"):
        reserve_inventory(inv, spark.createDataFrame([(1, 7, 8), (2, 7, -5), (3, 7, 9)], schema))
    after, dec = reserve_inventory(inv, spark.createDataFrame([(1, 7, None), (None, 7, 1), (3, 7, 4)], schema))
    assert after.first()["quantity_available"] == 6
    assert sorted((r["seq"], r["accepted"]) for r in dec.collect() if r["seq"]) == [(1, False), (3, True)]
    after, dec = reserve_inventory(inv, spark.createDataFrame([], schema))
    assert after.first()["quantity_available"] == 10 and dec.count() == 0


def test_merge_matched_unmatched_and_null_key(spark):
    tgt = empty_table(spark, "sales_summary").unionByName(spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), 5, Decimal("50.00"), None, None, dt.datetime(2024, 1, 1)),
         (2, dt.date(2024, 1, 2), 6, Decimal("60.00"), 9, None, dt.datetime(2024, 1, 2))],
        SCHEMAS["sales_summary"]))
    src = spark.createDataFrame([(dt.date(2024, 1, 2), 7, Decimal("70.00")), (dt.date(2024, 1, 3), 8, Decimal("80.00")),
                                 (None, 1, Decimal("1.00"))],
                                "summary_date date, total_orders bigint, total_revenue decimal(15,2)")
    out = upsert(tgt, src, ["summary_date"], ["total_orders", "total_revenue"], id_col="summary_id",
                 table="sales_summary", as_of="2024-01-05 00:00:00")
    rows = {r.summary_id: r for r in out.collect()}
    assert rows[1].total_orders == 5                                  # d1 kept
    assert (rows[2].total_orders, rows[2].total_customers) == (7, 9)  # d2: two columns updated only
    new = sorted((r.summary_id, r.summary_date) for r in out.where(F.col("summary_id") > 2).collect())
    assert new == [(3, None), (4, dt.date(2024, 1, 3))]               # NULL key never matches; ids after max
    assert rows[4].created_at == dt.datetime(2024, 1, 5)


def test_merge_rejects_duplicate_source_keys(spark):
    tgt = empty_table(spark, "sales_summary")
    src = spark.createDataFrame([(dt.date(2024, 1, 2), 1, Decimal("1")), (dt.date(2024, 1, 2), 2, Decimal("2"))],
                                "summary_date date, total_orders bigint, total_revenue decimal(15,2)")
    with pytest.raises(MergeError):
        upsert(tgt, src, ["summary_date"], ["total_orders", "total_revenue"], id_col="summary_id")


def test_merge_sales_summary_on_tables(spark, tables):
    out = merge_sales_summary(tables, empty_table(spark, "sales_summary"), AS_OF)
    assert out.count() == out.select("summary_id").distinct().count()


def test_price_orders_shipping_rule(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id bigint")
    items = spark.createDataFrame([(2, 1, Decimal("100.00")), (3, 1, Decimal("100.01"))],
                                  "order_id bigint, quantity bigint, unit_price decimal(10,2)")
    got = {r.order_id: (r.shipping_cost, r.tax_amount, r.total_amount)
           for r in B.price_orders(orders, items).collect()}
    assert got[1] == (Decimal("10.00"), Decimal("0.00"), Decimal("10.00"))
    assert got[2] == (Decimal("10.00"), Decimal("8.00"), Decimal("118.00"))
    assert got[3] == (Decimal("0.00"), Decimal("8.00"), Decimal("108.01"))


def test_loyalty_null_stays_null(spark):
    c = spark.createDataFrame([(1, None), (2, 5)], "customer_id bigint, loyalty_points bigint")
    d = spark.createDataFrame([(1, 3), (1, 4), (2, 3), (2, 4), (9, 1)], "customer_id bigint, points bigint")
    got = {r.customer_id: r.loyalty_points for r in B.apply_loyalty_deltas(c, d).collect()}
    assert got == {1: None, 2: 12}


def test_last_write_wins_including_null(spark):
    c = spark.createDataFrame([(1, "REGULAR"), (2, "REGULAR"), (3, "VIP")], "customer_id bigint, customer_type string")
    ch = spark.createDataFrame([(1, "VIP", 2), (1, "PREMIUM", 5), (2, None, 1), (7, "VIP", 1)],
                               "customer_id bigint, customer_type string, seq bigint")
    got = {r.customer_id: r.customer_type for r in B.set_customer_type(c, ch).collect()}
    assert got == {1: "PREMIUM", 2: None, 3: "VIP"}


def test_purge_only_old_finished_orders(spark):
    o = spark.createDataFrame([(1, "COMPLETED", dt.datetime(2001, 1, 1)), (2, "PENDING", dt.datetime(2001, 1, 1)),
                               (3, "COMPLETED", dt.datetime(2001, 7, 30))],
                              "order_id bigint, status string, order_date timestamp_ntz")
    i = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "order_id bigint, product_id bigint")
    tx = spark.createDataFrame([(5, 1), (6, 3)], "transaction_id bigint, order_id bigint")
    out = B.purge_old_orders(o, i, tx, AS_OF)
    assert sorted(r.order_id for r in out["orders"].collect()) == [2, 3]
    assert sorted(r.order_id for r in out["order_items"].collect()) == [2, 3]
    assert sorted(r.order_id for r in out["transactions"].collect()) == [3]


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    out = assign_ids(df, ["k"], id_col="id", start=5, num_partitions=7).collect()
    assert sorted((r.k, r.id) for r in out) == [(k, k + 5) for k in range(1000)]


def test_defaults_fill_missing_keep_explicit_null(spark):
    df = spark.createDataFrame([(1, None)], "customer_id bigint, customer_type string")
    r = apply_defaults(df, "customers", AS_OF).collect()[0]
    assert r.customer_type is None and r.loyalty_points == 0 and r.created_at == dt.datetime(2001, 8, 1, 12)


def test_constraints_find_each_kind(spark):
    cust = spark.createDataFrame([(1, "a", "b", "x@e"), (1, "c", None, "x@e"), (None, "e", "f", "y@e")],
                                 "customer_id bigint, first_name string, last_name string, email string")
    orders = spark.createDataFrame([(10, 1, "NEW"), (11, 42, "NEW")], "order_id bigint, customer_id bigint, status string")
    rep = {r.constraint_name: r.violating_rows for r in constraint_report({"customers": cust, "orders": orders}).collect()}
    assert rep["pk_customers"] == 2 and rep["pk_customers_null"] == 1
    assert rep["uq_customers_email"] == 2 and rep["nn_customers_last_name"] == 1
    assert rep["fk_orders_customer_id"] == 1 and rep["pk_orders"] == 0
    assert constraint_violations({"customers": cust, "orders": orders}).count() == 5


def test_audit_diff_operations(spark):
    before = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id bigint, v bigint")
    after = spark.createDataFrame([(1, 5), (2, 9), (4, 1)], "id bigint, v bigint")
    got = {(r.record_id, r.operation, r.old_value, r.new_value)
           for r in audit_diff(before, after, "id", "T", as_of=AS_OF).collect()}
    assert got == {(2, "UPDATE", '{"v":6}', '{"v":9}'), (3, "DELETE", '{"v":7}', None), (4, "INSERT", None, '{"v":1}')}


def test_place_orders_pipeline(spark, tables):
    reqs = spark.createDataFrame([(1, 1, None), (2, 2, "PAYPAL")],
                                 "request_id bigint, customer_id bigint, payment_method string")
    pid = tables["products"].agg(F.min("product_id")).first()[0]
    lines = spark.createDataFrame([(1, 1, pid, 2), (1, 2, -5, 1), (2, 1, pid, 1)],
                                  "request_id bigint, line_no bigint, product_id bigint, quantity bigint")
    out = B.place_orders(tables, reqs, lines, AS_OF)
    new = {r.customer_id: r for r in out["new_orders"].collect()}
    assert new[1].payment_method == "CREDIT_CARD" and new[2].payment_method == "PAYPAL"
    assert all(r.status == "COMPLETED" for r in new.values())
    assert out["new_items"].count() == 2  # unknown product skipped
    assert out["new_transactions"].count() == 2
    assert out["orders"].count() == tables["orders"].count() + 2


def test_reserve_hot_product_matches_fold(spark):
    """One product receives every request (a third of all rows and more): the two-level
    prefix sum spreads it over chunks and still equals the literal fold."""
    inv = _inv(spark, [(1, 7, 500, 0), (2, 7, 37, 0), (3, 8, 5, 0)])
    req = spark.range(1, 3001).select(F.col("id").alias("seq"), F.lit(7).cast("bigint").alias("product_id"),
                                      ((F.col("id") * 7919) % 9 + 1).alias("quantity"))
    after, _ = reserve_inventory(inv, req, chunk=64)
    fold = fold_reservations(inv, req)
    assert {r["inventory_id"]: (r["quantity_available"], r["quantity_reserved"]) for r in after.collect()} == {
        k: v[:2] for k, v in fold.items()}


def test_key_lookup_pushes_short_lists(spark, tables):
    import contextlib
    import io
    out = B.lookup_by_literals(tables["orders"], "order_id", 1, 2, 3)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain("formatted")
    assert "In(o_orderkey" in buf.getvalue()
    ids = tables["orders"].select("order_id").limit(5)
    assert B.lookup_by_key(tables["orders"], "order_id", ids).count() == 5


def test_dashboard_empty_day_is_null_revenue(spark, tables):
    from ledgerline.plans.analytics import executive_dashboard
    rows = {r.metric: r for r in executive_dashboard(tables, as_of="2030-01-01 00:00:00").collect()}
    assert rows["Orders"].today_count == 0 and rows["Orders"].yesterday_count == 0
    assert rows["Revenue"].today_count is None and rows["Revenue"].yesterday_count is None


def test_daily_sales_drops_orders_without_items_and_counts_fan_out(spark):
    from decimal import Decimal

    from ledgerline.plans.analytics import daily_sales
    o = spark.createDataFrame([(1, dt.datetime(2001, 7, 30, 9), Decimal("10.00")),
                               (2, dt.datetime(2001, 7, 30, 10), Decimal("5.00")),
                               (3, dt.datetime(2001, 7, 31, 0), Decimal("7.00"))],
                              "order_id bigint, order_date timestamp_ntz, total_amount decimal(12,2)")
    i = spark.createDataFrame([(1,), (1,), (1,), (3,)], "order_id bigint")
    t = {"orders": o, "order_items": i}
    got = {r.order_day: (r.total_orders, r.revenue) for r in daily_sales(t, AS_OF).collect()}
    assert got == {dt.date(2001, 7, 30): (1, Decimal("30.00")), dt.date(2001, 7, 31): (1, Decimal("7.00"))}
    got = {r.order_day: (r.total_orders, r.revenue) for r in daily_sales(t, AS_OF, dedup=True).collect()}
    assert got[dt.date(2001, 7, 30)] == (1, Decimal("10.00"))


def test_assign_ids_same_ids_for_any_partitioning(spark):
    df = spark.range(0, 3000).select((F.col("id") % 37).alias("k"), (F.col("id") * 13 % 101).alias("v"))
    small = sorted((r.k, r.v, r.id) for r in assign_ids(df, ["k"], id_col="id", start=10).collect())
    dist = sorted((r.k, r.v, r.id) for r in assign_ids(df, ["k"], id_col="id", start=10, num_partitions=5).collect())
    assert small == dist
    assert [r[2] for r in sorted(small, key=lambda x: x[2])] == list(range(10, 3010))


def test_merge_duplicates_with_null_key_part_are_allowed(spark):
    from ledgerline.operators.upsert import check_unique_keys
    src = spark.createDataFrame([(1, None, 5), (1, None, 6), (2, 3, 7)], "a bigint, b bigint, v bigint")
    check_unique_keys(src, ["a", "b"])     # (1, NULL) can never match: no error
    with pytest.raises(MergeError):
        check_unique_keys(src.unionByName(src.where("a = 2")), ["a", "b"])


def test_lookups_unknown_ids_give_nulls(spark, tables):
    ids = spark.createDataFrame([(1,), (-7,)], "product_id bigint")
    got = {r.product_id: r.product_name for r in B.lookup_products(tables["products"], ids).collect()}
    assert got[-7] is None and got[1] is not None
    cids = spark.createDataFrame([(1,), (-7,)], "customer_id bigint")
    got = {r.customer_id: r.email for r in B.lookup_customers(tables["customers"], cids).collect()}
    assert got[-7] is None and got[1] == "customer1@example.com"


def test_check_inventory_sum_and_per_row(spark):
    inv = _inv(spark, [(1, 100, 10, 0), (2, 100, 4, 0)])
    ids = spark.createDataFrame([(100,), (200,)], "product_id bigint")
    assert {r.product_id: r.quantity_available for r in B.check_inventory(inv, ids).collect()} == {100: 14, 200: 0}
    rows = sorted((r.product_id, r.inventory_id, r.quantity_available)
                  for r in B.check_inventory(inv, ids, per_row=True).collect())
    assert rows == [(100, 1, 10), (100, 2, 4), (200, None, 0)]


def test_restock_adds_duplicates_to_every_warehouse_row(spark):
    inv = spark.createDataFrame([(1, 100, 10, dt.datetime(2001, 1, 1)), (2, 100, 4, None), (3, 200, 5, None)],
                                "inventory_id bigint, product_id bigint, quantity_available bigint, "
                                "last_restock_date timestamp_ntz")
    d = spark.createDataFrame([(100, 3), (100, 4)], "product_id bigint, quantity bigint")
    got = {r.inventory_id: (r.quantity_available, r.last_restock_date)
           for r in B.restock_inventory(inv, d, as_of=AS_OF).collect()}
    assert got == {1: (17, dt.datetime(2001, 8, 1, 12)), 2: (11, dt.datetime(2001, 8, 1, 12)), 3: (5, None)}


def test_sessions_create_is_repeatable_and_end_flags(spark):
    reqs = spark.createDataFrame([(1, 10, "ua"), (2, 11, None)], "request_id bigint, customer_id bigint, user_agent string")
    a = sorted(tuple(r) for r in B.create_sessions(reqs, "2024-01-31 00:00:00").collect())
    b = sorted(tuple(r) for r in B.create_sessions(reqs, "2024-01-31 00:00:00").collect())
    assert a == b and all(r[7] == 1 for r in a)
    assert all(len(r[0]) == 36 and r[0].count("-") == 4 for r in a)
    s = B.create_sessions(reqs, "2024-01-31 00:00:00")
    first = s.orderBy("customer_id").first().session_id
    ended = {r.session_id: r.is_active for r in
             B.end_sessions(s, spark.createDataFrame([(first,)], "session_id string")).collect()}
    assert ended[first] == 0 and sorted(ended.values()) == [0, 1]


def test_process_transactions_ranges_and_repeatable(spark):
    ids = spark.range(1, 501).select(F.col("id").alias("order_id"))
    a = B.process_transactions(ids, 1000, AS_OF).collect()
    b = B.process_transactions(ids, 1000, AS_OF).collect()
    assert sorted(tuple(r) for r in a) == sorted(tuple(r) for r in b)
    assert {r.payment_gateway for r in a} == set(B.GATEWAYS)
    assert all(50 <= r.amount < 500 and r.currency == "USD" and r.status == "COMPLETED" for r in a)
    assert sorted(r.transaction_id for r in a) == list(range(1000, 1500))
