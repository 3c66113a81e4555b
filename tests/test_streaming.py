"""Streams equal batch on the same input."""

import tempfile

from pyspark.sql import functions as F

from ledgerline.operators.ids import assign_ids
from ledgerline.plans.warehouse import ROLLUP_STATUSES
from ledgerline.streaming import (ORDER_STREAM_SCHEMA, REQUEST_STREAM_SCHEMA, apply_order_batch, apply_request_batch,
                                  daily_totals_stream, read_decisions, read_order_stream, read_sales_summary,
                                  start_reservation_stream, start_sales_summary_stream)


def _split_orders(tables, root):
    o = tables["orders"].select("order_id", "customer_id", "order_date", "status", "total_amount", "payment_method")
    for i, (lo, hi) in enumerate([("1990-01-01", "1997-01-01"), ("1997-01-01", "1999-06-01"), ("1999-06-01", "2100-01-01")]):
        o.where((F.col("order_date") >= F.lit(lo).cast("timestamp_ntz")) &
                (F.col("order_date") < F.lit(hi).cast("timestamp_ntz"))).coalesce(1) \
            .write.parquet(f"{root}/part{i}")
    return o


def test_t1_stream_equals_batch(spark, tables):
    root = tempfile.mkdtemp(prefix="ll-t1-")
    o = _split_orders(tables, f"{root}/in")
    # the file source reads one folder: move each part in as its own file set
    src = f"{root}/in"
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(src)
    q = start_sales_summary_stream(stream, f"{root}/target", f"{root}/ckpt")
    q.awaitTermination(300)
    got = sorted((r.summary_date, r.total_orders, r.total_revenue) for r in read_sales_summary(spark, f"{root}/target").collect())
    exp = (o.where(F.col("status").isin(list(ROLLUP_STATUSES))).groupBy(F.to_date("order_date").alias("d"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("decimal(15,2)").alias("r")))
    assert got == sorted((r.d, r.n, r.r) for r in exp.collect())


def test_t2_daily_totals_stream(spark, tables):
    root = tempfile.mkdtemp(prefix="ll-t2-")
    o = _split_orders(tables, f"{root}/in")
    stream = read_order_stream(spark, f"{root}/in/*", max_files=1)
    q = (daily_totals_stream(stream).writeStream.outputMode("update").format("memory").queryName("ll_t2")
         .option("checkpointLocation", f"{root}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT order_day, max_by(total_orders, total_orders) AS n, max_by(revenue, total_orders) AS r "
                    "FROM ll_t2 GROUP BY order_day")
    exp = o.groupBy(F.to_date("order_date").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("decimal(38,2)").alias("r"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in exp.collect())


def test_t3_reservation_stream_equals_batch_fold(spark, tables):
    from brute import fold_reservations

    from ledgerline.schema import SCHEMAS
    from ledgerline.sources.sinks import read_table, replace_table
    root = tempfile.mkdtemp(prefix="ll-t3-")
    inv = tables["inventory"].withColumn("quantity_available", F.col("quantity_available") % 60).withColumn(
        "quantity_reserved", F.lit(3).cast("bigint"))
    stored = inv.select(*[(F.col(f.name) if f.name in inv.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in SCHEMAS["inventory"].fields])
    replace_table(stored, f"{root}/store/inventory")
    req = assign_ids(tables["order_items"].select("order_id", "product_id", "quantity"),
                     ["order_id", "product_id", "quantity"], id_col="seq").select("seq", "product_id", "quantity")
    n = req.count()
    for i, (lo, hi) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n + 1)]):
        req.where((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.parquet(f"{root}/in/b{i}")
    stream = spark.readStream.schema(REQUEST_STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    start_reservation_stream(stream, f"{root}/store", f"{root}/ckpt").awaitTermination()
    apply_request_batch(req, 1, f"{root}/store")  # a replayed batch changes nothing
    exp = fold_reservations(inv, req)
    got = {r["inventory_id"]: (r["quantity_available"], r["quantity_reserved"])
           for r in read_table(spark, f"{root}/store/inventory", "inventory").collect()}
    assert got == {k: v[:2] for k, v in exp.items()}
    dec = read_decisions(spark, f"{root}/store")
    assert dec.count() == req.join(inv, "product_id").count()
    took = {}
    for r in dec.where("accepted").collect():
        took.setdefault(r["inventory_id"], set()).add(r["seq"])
    assert took == {k: v[2] for k, v in exp.items() if v[2]}


def test_t1_status_changes_and_replays(spark):
    """An order counted as SHIPPED and again as COMPLETED counts once; one that is cancelled leaves its day."""
    import datetime as dt
    from decimal import Decimal
    root = tempfile.mkdtemp(prefix="ll-t1s-")
    row = lambda i, d, s, v: (i, 1, dt.datetime(2001, 7, d, 9), s, Decimal(v), "CARD")
    batches = [[row(1, 20, "SHIPPED", "10.00"), row(2, 20, "PENDING", "5.00"), row(3, 21, "SHIPPED", "7.00")],
               [row(1, 20, "COMPLETED", "10.00"), row(2, 20, "SHIPPED", "5.00")],
               [row(3, 21, "CANCELLED", "7.00"), row(1, 20, "SHIPPED", "10.00"), row(4, 25, "PENDING", "1.00")]]
    for b in [batches[0], batches[0], *batches[1:], batches[2]]:
        apply_order_batch(spark.createDataFrame(b, ORDER_STREAM_SCHEMA), root)
    got = {r["summary_date"].day: (r["total_orders"], r["total_revenue"]) for r in read_sales_summary(spark, root).collect()}
    assert got == {20: (2, Decimal("15.00")), 21: (0, None)}
    apply_order_batch(spark.createDataFrame([row(5, 30, "SHIPPED", "2.00"), row(2, 20, "CANCELLED", "5.00")], ORDER_STREAM_SCHEMA), root)
    got = {r["summary_date"].day: r["total_orders"] for r in read_sales_summary(spark, root).collect()}
    assert got == {20: 2, 21: 0, 30: 1}  # the 20th is beyond the eight days


def test_t2_dedup_append_mode_drops_replayed_orders(spark, tables):
    root = tempfile.mkdtemp(prefix="ll-t2d-")
    o = tables["orders"].select("order_id", "customer_id", "order_date", "status", "total_amount", "payment_method")
    o.coalesce(1).write.parquet(f"{root}/in/a")
    o.coalesce(1).write.parquet(f"{root}/in/b")          # every order delivered twice
    stream = read_order_stream(spark, f"{root}/in/*", max_files=1)
    q = (daily_totals_stream(stream, dedup=True).writeStream.outputMode("append").format("memory")
         .queryName("ll_t2d").option("checkpointLocation", f"{root}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = {r.order_day: (r.total_orders, r.revenue) for r in spark.table("ll_t2d").collect()}
    exp = {r.d: (r.n, r.r) for r in o.groupBy(F.to_date("order_date").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("decimal(38,2)").alias("r")).collect()}
    assert got, "append mode emitted no closed day"
    for day, v in got.items():          # each emitted (closed) day counts every order once
        assert v == exp[day], day


def test_t2_late_order_within_allowance_updates_its_day(spark, tables):
    """A later micro-batch carries orders three days older than the newest seen:
    inside the 8-day allowance, so their day is updated, not dropped."""
    root = tempfile.mkdtemp(prefix="ll-t2late-")
    o = tables["orders"].select("order_id", "customer_id", "order_date", "status", "total_amount", "payment_method")
    newest = o.agg(F.max("order_date")).first()[0]
    cut = F.lit(str(newest)).cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS")
    on_time = o.where((F.col("order_date") < cut) | (F.col("order_date") == F.lit(str(newest)).cast("timestamp_ntz")))
    late = o.where((F.col("order_date") >= cut) & (F.col("order_date") < F.lit(str(newest)).cast("timestamp_ntz")))
    assert late.count() > 0
    on_time.coalesce(1).write.parquet(f"{root}/in/a")
    late.coalesce(1).write.parquet(f"{root}/in/b")
    stream = read_order_stream(spark, f"{root}/in/*", max_files=1)
    q = (daily_totals_stream(stream).writeStream.outputMode("update").format("memory").queryName("ll_t2late")
         .option("checkpointLocation", f"{root}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT order_day, max(total_orders) AS n FROM ll_t2late GROUP BY order_day")
    exp = o.groupBy(F.to_date("order_date").alias("order_day")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in exp.collect())


def _orders(spark, rows):
    """rows: (order_id, day text or None, status, amount)."""
    import datetime as dt
    from decimal import Decimal
    return spark.createDataFrame([(i, 1, None if d is None else dt.datetime.fromisoformat(d), s, None if v is None else Decimal(v), "CARD")
                                  for i, d, s, v in rows], ORDER_STREAM_SCHEMA)


def _feed(spark, root, rows):
    """Rows appended to the stream's folder, and the stream run over them from its checkpoint (one micro-batch)."""
    _orders(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    start_sales_summary_stream(read_order_stream(spark, f"{root}/in"), f"{root}/target", f"{root}/ckpt").awaitTermination()
    return {str(r["summary_date"]): (r["total_orders"], None if r["total_revenue"] is None else str(r["total_revenue"]))
            for r in read_sales_summary(spark, f"{root}/target").collect()}


def test_t1_state_counts_newest_versions_over_restarts(spark):
    root = tempfile.mkdtemp(prefix="ll-t1r-")
    first = [(1, "2001-07-20T09:00", "SHIPPED", "10.00"), (2, "2001-07-20T09:00", "PENDING", "5.00"), (3, "2001-07-21T09:00", "SHIPPED", "7.00")]
    assert _feed(spark, root, first) == {"2001-07-20": (1, "10.00"), "2001-07-21": (1, "7.00")}
    assert _feed(spark, root, first) == {"2001-07-20": (1, "10.00"), "2001-07-21": (1, "7.00")}  # a replay
    got = _feed(spark, root, [(1, "2001-07-20T09:00", "COMPLETED", "10.00"), (2, "2001-07-20T09:00", "SHIPPED", "5.00"),
                              (3, "2001-07-21T09:00", "CANCELLED", "7.00"), (4, "2001-07-25T00:00", "SHIPPED", None)])
    assert got == {"2001-07-20": (2, "15.00"), "2001-07-21": (0, None), "2001-07-25": (1, None)}
    # an earlier version that comes late changes nothing; an order may move to another day
    got = _feed(spark, root, [(1, "2001-07-20T09:00", "PENDING", "99.00"), (2, "2001-07-22T23:59", "DELIVERED", "6.00")])
    assert got == {"2001-07-20": (1, "10.00"), "2001-07-21": (0, None), "2001-07-22": (1, "6.00"), "2001-07-25": (1, None)}
    # eight days on, the timers have dropped the old orders, and their days are closed
    got = _feed(spark, root, [(5, "2001-08-09T08:00", "SHIPPED", "1.00")])
    got = _feed(spark, root, [(1, "2001-07-20T09:00", "CANCELLED", "10.00"), (6, "2001-08-08T08:00", "SHIPPED", "2.00")])
    assert got["2001-07-20"] == (1, "10.00") and got["2001-08-08"] == (1, "2.00") and got["2001-08-09"] == (1, "1.00")
    ids = [r["summary_id"] for r in read_sales_summary(spark, f"{root}/target").orderBy("summary_date").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_t1_future_and_null_dates_are_set_aside(spark):
    from ledgerline.streaming import read_set_aside
    root = tempfile.mkdtemp(prefix="ll-t1f-")
    assert _feed(spark, root, [(1, None, "SHIPPED", "1.00"), (None, None, "SHIPPED", "1.00")]) == {}
    _feed(spark, root, [(1, "2001-07-20T09:00", "SHIPPED", "10.00"), (2, "2001-07-20T09:00", "SHIPPED", "5.00")])
    _feed(spark, root, [(3, "2100-01-01T00:00", "SHIPPED", "1000.00")])
    got = _feed(spark, root, [(2, "2001-07-20T09:00", "CANCELLED", "5.00"), (4, "2001-07-21T09:00", "SHIPPED", "4.00")])
    assert got == {"2001-07-20": (1, "10.00"), "2001-07-21": (1, "4.00")}
    aside = sorted(((r["order_id"], r["order_date"] and r["order_date"].year) for r in read_set_aside(spark, f"{root}/target").collect()), key=repr)
    assert aside == [(1, None), (3, 2100), (None, None)]


def _fold_orders(batches):
    """T1 order by order in plain Python, a run per batch: day -> (orders, revenue in cents or None)."""
    import datetime as dt

    from ledgerline.streaming import RECOMPUTE_DAYS, STATUS_ORDER
    mark, days, state, known = 0, {}, {}, set()
    stay = RECOMPUTE_DAYS * 86_400_000
    for rows in batches:
        seen = [(i, (dt.datetime.fromisoformat(d) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), s, v)
                for i, d, s, v in rows if d is not None and i is not None]
        for i, event, s, v in seen:
            if mark and event <= mark * 1000:
                continue
            version = (STATUS_ORDER.index(s) + 1 if s in STATUS_ORDER else 0, event, v is not None, int(float(v or 0) * 100 + 0.5))
            before = state.get(i, ((-1,), None))[0]
            best = max(before, version)
            state[i] = best, max(best[1] // 1000 + stay, mark + 1)
            for x, sign in ((before, -1), (best, 1)):
                if best != before and x[0] >= 0 and x[0] and STATUS_ORDER[x[0] - 1] in ROLLUP_STATUSES:
                    t = days.setdefault(str(dt.date(1970, 1, 1) + dt.timedelta(days=x[1] // 86_400_000_000)), [0, 0, 0])
                    t[0], t[1], t[2] = t[0] + sign, t[1] + sign * x[2], t[2] + sign * x[3]
        known |= {d for d, t in days.items() if t[0] > 0}
        mark = max([mark, *(e // 1000 - stay for _, e, _, _ in seen)])
        state = {i: x for i, x in state.items() if x[1] >= mark}
    return {d: (t[0], t[2] if t[1] else None) for d, t in days.items() if d in known}, len(state)


def test_t1_state_function_takes_many_orders_at_once(spark):
    """The state is held by groups of orders, far fewer than orders, and gives what order by order gives."""
    import datetime as dt
    import random

    from ledgerline.streaming import STATUS_ORDER, read_set_aside
    rng, root, groups = random.Random(5), tempfile.mkdtemp(prefix="ll-t1g-"), 16
    batches = []
    for k in range(4):  # batches six days apart, each of ten days: some rows are late, some orders come again after their timers
        rows = []
        for _ in range(400):
            at = dt.datetime(2001, 7, 1) + dt.timedelta(days=6 * k, seconds=rng.randrange(10 * 86400), microseconds=rng.randrange(1000))
            i = rng.choice([rng.randrange(300), 2 ** 60 + rng.randrange(100)])
            rows.append((rng.choice([i] * 40 + [None]), rng.choice([at.isoformat()] * 30 + [None]),
                         rng.choice([*STATUS_ORDER[:6], *STATUS_ORDER, "ODD", None]), rng.choice([f"{rng.randrange(1, 9999) / 100:.2f}"] * 5 + [None])))
        batches.append(rows + rng.sample(batches[-1], 60) if batches else rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a group comes in several frames
    try:
        for rows in batches:
            _orders(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
            q = start_sales_summary_stream(read_order_stream(spark, f"{root}/in"), f"{root}/target", f"{root}/ckpt", groups=groups)
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    exp, held = _fold_orders(batches)
    got = {str(r["summary_date"]): (r["total_orders"], None if r["total_revenue"] is None else int(r["total_revenue"] * 100))
           for r in read_sales_summary(spark, f"{root}/target").collect()}
    assert got == exp
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= groups < held
    aside = [(r["order_id"], r["order_date"] and r["order_date"].isoformat(), r["status"], r["total_amount"] and f"{r['total_amount']:.2f}")
             for r in read_set_aside(spark, f"{root}/target").collect()]
    assert sorted(aside, key=repr) == sorted((r for rows in batches for r in rows if r[0] is None or r[1] is None), key=repr)


def test_t1_batch_form_with_future_and_null_dates(spark):
    root = tempfile.mkdtemp(prefix="ll-t1b-")
    apply_order_batch(_orders(spark, [(1, None, "SHIPPED", "1.00")]), root)
    apply_order_batch(_orders(spark, [(1, "2001-07-20T09:00", "SHIPPED", "10.00"), (2, "2001-07-20T09:00", "SHIPPED", "5.00"),
                                      (9, None, "SHIPPED", "5.00")]), root)
    apply_order_batch(_orders(spark, [(3, "2100-01-01T00:00", "SHIPPED", "1000.00")]), root)
    apply_order_batch(_orders(spark, [(2, "2001-07-20T09:00", "CANCELLED", "5.00"), (4, "2001-07-21T09:00", "SHIPPED", "4.00")]), root)
    got = {str(r["summary_date"]): (r["total_orders"], str(r["total_revenue"])) for r in read_sales_summary(spark, root).collect()}
    assert got == {"2001-07-20": (1, "10.00"), "2001-07-21": (1, "4.00")}


def test_t1_a_published_batch_is_not_added_twice(spark):
    from ledgerline.streaming import CHANGES, apply_day_deltas
    import datetime as dt
    root = tempfile.mkdtemp(prefix="ll-t1p-")
    changes = spark.createDataFrame([(dt.date(2001, 7, 1), 1, 1, 250, False, None, None, None, None)], CHANGES)
    for batch_id in (0, 0, 1):
        apply_day_deltas(changes, batch_id, root)
    assert [(r["total_orders"], str(r["total_revenue"])) for r in read_sales_summary(spark, root).collect()] == [(2, "5.00")]


def _stock(spark, root, rows):
    from ledgerline.schema import SCHEMAS
    from ledgerline.sources.sinks import replace_table
    inv = spark.createDataFrame([(i, p, q, 0) for i, p, q in rows],
                                "inventory_id long, product_id long, quantity_available long, quantity_reserved long")
    replace_table(inv.select(*[(F.col(f.name) if f.name in inv.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in SCHEMAS["inventory"].fields]), f"{root}/inventory")
    return inv


def test_t3_shuffled_batches_decide_in_order(spark):
    """Requests shuffled within the lag, over batches that overlap and repeat, give the decisions of B7 in order."""
    import random

    from brute import fold_reservations

    from ledgerline.sources.sinks import read_table
    from ledgerline.streaming import flush_requests, read_late_requests
    rng, root = random.Random(4), tempfile.mkdtemp(prefix="ll-t3l-")
    inv = _stock(spark, f"{root}/store", [(1, 1, 40), (2, 1, 9), (3, 2, 25), (4, 3, 0)])
    rows = [(s, rng.choice([1, 1, 2, 3, 4]), rng.randrange(1, 9)) for s in range(1, 121)]
    arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(0, 25))
    for k in range(4):  # each batch brings a few rows of the one before again
        part = arrival[max(0, 30 * k - 5):30 * k + 30]
        spark.createDataFrame(part, REQUEST_STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(REQUEST_STREAM_SCHEMA).parquet(f"{root}/in")
        start_reservation_stream(stream, f"{root}/store", f"{root}/ckpt", lag=30).awaitTermination()
    undecided = 120 - read_decisions(spark, f"{root}/store").select("seq").distinct().count()
    assert undecided >= 30 - 1
    flush_requests(spark, f"{root}/store")
    exp = fold_reservations(inv, spark.createDataFrame(rows, REQUEST_STREAM_SCHEMA))
    got = {r["inventory_id"]: (r["quantity_available"], r["quantity_reserved"])
           for r in read_table(spark, f"{root}/store/inventory", "inventory").collect()}
    assert got == {k: v[:2] for k, v in exp.items()}
    took = {}
    for r in read_decisions(spark, f"{root}/store").where("accepted").collect():
        took.setdefault(r["inventory_id"], set()).add(r["seq"])
    assert took == {k: v[2] for k, v in exp.items() if v[2]}
    assert read_late_requests(spark, f"{root}/store").count() == 0


def test_t3_late_and_repeated_requests(spark):
    from ledgerline.sources.sinks import read_table
    from ledgerline.streaming import flush_requests, read_late_requests
    root = tempfile.mkdtemp(prefix="ll-t3m-")
    _stock(spark, root, [(1, 1, 10)])
    send = lambda rows, k, lag=5: apply_request_batch(spark.createDataFrame(rows, REQUEST_STREAM_SCHEMA), k, root, lag)
    send([(1, 1, 2), (20, 1, 3), (None, 1, 1)], 0)
    send([(1, 1, 2), (20, 1, 3), (18, 1, 9)], 0)       # the batch was published: skipped
    send([(3, 1, 1), (1, 1, 2), (18, 1, 1), (20, 1, 3)], 1)  # 3 comes after 15 was passed; 1 is known; 18 is in time
    send([], 2)
    left = lambda: read_table(spark, f"{root}/inventory", "inventory").first()["quantity_available"]
    assert left() == 8 and [tuple(r) for r in read_late_requests(spark, root).collect()] == [(3, 1, 1)]
    flush_requests(spark, root)
    assert left() == 4 and sorted(r["seq"] for r in read_decisions(spark, root).collect()) == [1, 18, 20]
    flush_requests(spark, root)
    assert left() == 4
