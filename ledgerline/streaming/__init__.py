"""Structured Streaming forms of the rollup (T1, T2) and of reservations.

All sources and sinks are files (parquet folders); no server is involved.

* T1 ``start_sales_summary_stream``: the newest version of every recent order
  is streaming state, held by groups of order ids, which a timer per order
  drops eight days (of order time) later.  A change yields signed deltas for the days it touches;
  each micro-batch adds them up and merges those days into SALES_SUMMARY (U1).
  What is written a batch is days, never orders.
  ``apply_order_batch`` is the same for a single batch given as a table.
* T2 ``daily_totals_stream``: event-time windows of one day with a
  watermark; late orders inside the allowance still update their day.
* T3 ``start_reservation_stream``: each micro-batch's requests run through
  the batch operator (B7) against the stored stock, so a hot product is
  spread over tasks and restocks between batches count.  Stock and the
  number of the batch are published together.  With a lag, requests that come
  out of order wait in a buffer and are decided in order.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reserve import reserve_inventory
from ..operators.upsert import upsert
from ..plans.warehouse import ROLLUP_STATUSES, empty_table
from ..session import materialize, ship_package
from ..sources.sinks import current_path, note, read_table, replace_tables, table_exists

ORDER_STREAM_SCHEMA = ("order_id bigint, customer_id bigint, order_date timestamp_ntz, status string, "
                       "total_amount decimal(12,2), payment_method string")
REQUEST_STREAM_SCHEMA = "seq bigint, product_id bigint, quantity bigint"


def read_order_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A file stream of orders (parquet, explicit schema); ``max_files`` bounds each micro-batch."""
    r = spark.readStream.schema(ORDER_STREAM_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


# --------------------------------------------------------------------------- T1
RECOMPUTE_DAYS = 8
# Of several versions of an order the farthest one counts (fixed order of the workflow).
STATUS_ORDER = ("PENDING", "PAYMENT_FAILED", "PAID", "SHIPPED", "COMPLETED", "DELIVERED", "RETURNED", "CANCELLED")
ORDER_STATE = "order_id bigint, order_date timestamp_ntz, status string, total_amount decimal(12,2)"


#: How far ahead of the clock an order may be dated; rows beyond it, and rows without a date, are set aside.
AHEAD = "INTERVAL 1 DAY"


def usable(clock: Column | None = None) -> Column:
    """Whether an order's date is given and not beyond the clock: one order of the year 2100 must not close all days before it."""
    now = F.localtimestamp() if clock is None else clock.cast("timestamp_ntz")
    return F.coalesce(F.col("order_id").isNotNull() & (F.col("order_date") <= now + F.expr(AHEAD)), F.lit(False))


def _place() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in STATUS_ORDER]), F.col("status"))


def apply_order_batch(batch: DataFrame, target: str, clock: Column | None = None) -> None:
    """One batch of orders as a table: newest state of the recent orders, touched days recomputed and merged.

    Rows without a date or dated beyond the clock are not counted.
    """
    spark = batch.sparkSession
    rows = materialize(batch.where(usable(clock)).select("order_id", "order_date", "status", "total_amount"), "t1-batch")
    if rows.isEmpty():
        return
    path = f"{target}/order_state"
    state = (spark.read.schema(ORDER_STATE).parquet(current_path(spark, path)) if table_exists(spark, path)
             else spark.createDataFrame([], ORDER_STATE))
    newest = state.unionByName(rows).groupBy("order_id").agg(
        F.max(F.struct(_place().alias("place"), "order_date", "status", "total_amount")).alias("o")).select("order_id", "o.*").drop("place")
    newest = materialize(newest, "t1-state")
    last = newest.agg(F.max("order_date")).first()[0]
    oldest = F.lit(last.date() - _dt.timedelta(days=RECOMPUTE_DAYS))
    summary = f"{target}/sales_summary"
    stored = read_table(spark, summary, "sales_summary") if table_exists(spark, summary) else empty_table(spark, "sales_summary")
    known = stored.select("summary_date").withColumn("_there", F.lit(True))
    # recent days are recomputed; an older one enters once, when it is first seen, and is closed from then on
    days = (rows.select(F.to_date("order_date").alias("summary_date")).distinct().join(known, "summary_date", "left")
            .where((F.col("summary_date") >= oldest) | F.col("_there").isNull()))
    counted = F.col("status").isin(list(ROLLUP_STATUSES))
    totals = (newest.select(F.to_date("order_date").alias("summary_date"), "status", "total_amount").join(days, "summary_date")
              .groupBy("summary_date", "_there").agg(F.count_if(counted).alias("total_orders"),
                                                     F.sum(F.when(counted, F.col("total_amount"))).alias("total_revenue")))
    # a day without counted orders enters the summary only if it is there already
    totals = totals.where("total_orders > 0 OR _there").drop("_there")
    merged = upsert(stored, totals, ["summary_date"], ["total_orders", "total_revenue"], id_col="summary_id",
                    table="sales_summary", as_of=last, check_unique=False)
    replace_tables({"order_state": newest.where(F.to_date("order_date") >= oldest), "sales_summary": merged}, target)


# What a change of an order yields: a delta of a day, or (``set_aside``) a row
# that is not counted.
CHANGES = ("summary_date date, orders long, priced long, cents long, set_aside boolean, order_id long, "
           "order_date timestamp_ntz, status string, total_amount decimal(12,2)")
DAY_TOTALS = "summary_date date, orders long, priced long, cents long"
_CHANGE_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
_DAY_US = 86_400_000_000

#: Order ids are hashed into this many groups, and the state function is called once a group, not once an order.  Like the
#: number of shuffle partitions it stays as it is for the life of a checkpoint.
ORDER_GROUPS = 1024
# The state of a group: an array of its orders' newest versions, each with the time (ms) of its timer.  The status is its
# place; those without a place count nowhere.
GROUP_STATE = "orders binary"
_VERSION = [("order_id", "i8"), ("place", "i4"), ("event", "i8"), ("priced", "?"), ("cents", "i8"), ("expires", "i8")]
_COUNTED = [STATUS_ORDER.index(s) + 1 for s in ROLLUP_STATUSES]


def _newest(rows):
    """Of each order the version that counts (farthest in the workflow, then newest, then by price, nulls first), by order id."""
    import numpy as np

    rows = rows[np.lexsort([rows[c] for c in ("cents", "priced", "event", "place", "order_id")])]
    return rows[np.append(rows["order_id"][1:] != rows["order_id"][:-1], True)[:len(rows)]]


def _deltas(left, entered):
    """The day deltas of versions that left the rollup and of versions that entered it, a row each."""
    import numpy as np
    import pandas as pd

    v, sign = np.concatenate([left, entered]), np.repeat([-1, 1], [len(left), len(entered)])
    counted = np.isin(v["place"], _COUNTED)
    v, sign = v[counted], sign[counted]
    days = (v["event"] // _DAY_US).astype("datetime64[D]").astype(object)
    return pd.DataFrame({**dict.fromkeys(_CHANGE_COLUMNS), "summary_date": days, "orders": sign, "priced": sign * v["priced"],
                         "cents": sign * v["cents"], "set_aside": False})


def _newest_versions(key, frames, state):
    """State function of a group of orders: deltas between the versions counted so far and the newest ones.

    Every order has a timer of its own; the group's timer is the earliest of them.
    """
    import numpy as np
    import pandas as pd

    mark = state.getCurrentWatermarkMs()
    before = np.frombuffer(state.get[0], _VERSION) if state.exists else np.empty(0, _VERSION)
    now = before
    if not state.hasTimedOut:
        came = [np.empty(0, _VERSION)]
        for f in frames:
            odd = f["odd"].to_numpy(bool)
            rows = np.zeros(len(f), _VERSION)
            for c in ("order_id", "place", "event", "priced", "cents"):
                rows[c] = f[c].to_numpy()
            came.append(_newest(rows[~odd]))
            if odd.any():
                r = f[odd].astype(object)
                yield pd.DataFrame({**dict.fromkeys(_CHANGE_COLUMNS), "set_aside": True, "order_id": r["order_id"].where(r["has_id"].astype(bool)),
                                    **{c: r[c] for c in ("order_date", "status", "total_amount")}})
        came = np.concatenate(came)
        now = _newest(np.concatenate([before, came]))
        at = np.searchsorted(now["order_id"], before["order_id"])
        now["expires"][at] = before["expires"]
        touched = np.isin(now["order_id"], came["order_id"])
        now["expires"][touched] = np.maximum(now["event"][touched] // 1000 + RECOMPUTE_DAYS * 86_400_000, mark + 1)
        same = np.logical_and.reduce([now[c][at] == before[c] for c in ("place", "event", "priced", "cents")])
        entered = np.ones(len(now), bool)
        entered[at[same]] = False
        out = _deltas(before[~same], now[entered])
        if len(out):
            yield out
    now = now[now["expires"] >= mark]
    if len(now):
        state.update((now.tobytes(),))
        state.setTimeoutTimestamp(int(now["expires"].min()))
    elif state.exists:
        state.remove()


def order_changes(orders: DataFrame, clock: Column | None = None, groups: int = ORDER_GROUPS) -> DataFrame:
    """A stream of orders as signed day deltas, by state of the newest versions with event-time timers per order.

    The state is held by groups of orders (a hash of the order id), so that
    the state function works on arrays.  A batch that touches a group writes
    that group's recent orders: more ``groups`` write less, for more calls.

    Rows older than the newest order seen in earlier batches by more than
    ``RECOMPUTE_DAYS`` are too late and dropped, as the rollup never looks
    further back.  Rows without a usable date come out as set aside; their
    null event time leaves the watermark alone.
    """
    event = F.when(usable(clock), F.col("order_date").cast("timestamp"))
    rows = orders.select("order_id", "order_date", "status", "total_amount", event.alias("_event")).withWatermark(
        "_event", f"{RECOMPUTE_DAYS} days")
    odd, cents = F.col("_event").isNull(), (F.col("total_amount") * 100).cast("long")
    # numbers without nulls, so that pandas keeps them as integers; the row itself only where it is set aside
    rows = rows.select(F.pmod(F.hash("order_id"), F.lit(groups)).alias("order_group"), "_event", odd.alias("odd"),
                       F.col("order_id").isNotNull().alias("has_id"), F.coalesce("order_id", F.lit(0)).alias("order_id"),
                       F.coalesce(_place().cast("int"), F.lit(0)).alias("place"),
                       F.coalesce(F.unix_micros("_event"), F.lit(0)).alias("event"),
                       cents.isNotNull().alias("priced"), F.coalesce(cents, F.lit(0)).alias("cents"),
                       *[F.when(odd, F.col(c)).alias(c) for c in ("order_date", "status", "total_amount")])
    return rows.groupBy("order_group").applyInPandasWithState(_newest_versions, CHANGES, GROUP_STATE, "append", "EventTimeTimeout")


def apply_day_deltas(changes: DataFrame, batch_id: int, target: str, as_of=None) -> None:
    """One micro-batch of T1: the deltas' days are merged; a batch that was published already is skipped.

    ``day_totals`` (a row per day) carries what SALES_SUMMARY doesn't: how
    many orders have a price, so that a day without any has no revenue.
    """
    spark = changes.sparkSession
    done = note(spark, target, "applied_batch")
    if done is not None and int(done) >= batch_id:
        return
    rows = materialize(changes, "t1-changes")
    if done is not None and rows.isEmpty():  # only timers ran
        return
    rows.where("set_aside").select("order_id", "order_date", "status", "total_amount").write.mode("overwrite").parquet(
        f"{target}/set_aside/batch_id={batch_id}")
    path, summary = f"{target}/day_totals", f"{target}/sales_summary"
    stored = spark.read.schema(DAY_TOTALS).parquet(current_path(spark, path)) if table_exists(spark, path) else \
        spark.createDataFrame([], DAY_TOTALS)
    deltas = rows.where("NOT set_aside").groupBy("summary_date").agg(*[F.sum(c).alias(c) for c in ("orders", "priced", "cents")])
    deltas = materialize(deltas, "t1-deltas")
    totals = materialize(stored.unionByName(deltas).groupBy("summary_date").agg(
        *[F.sum(c).alias(c) for c in ("orders", "priced", "cents")]), "t1-totals")
    known = read_table(spark, summary, "sales_summary") if table_exists(spark, summary) else empty_table(spark, "sales_summary")
    touched = totals.join(deltas.select("summary_date"), "summary_date", "left_semi").join(
        known.select("summary_date", F.lit(True).alias("_there")), "summary_date", "left").where("orders > 0 OR _there")
    revenue = F.when(F.col("priced") > 0, F.col("cents").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)"))
    source = touched.select("summary_date", F.col("orders").alias("total_orders"), revenue.cast("decimal(15,2)").alias("total_revenue"))
    merged = upsert(known, source, ["summary_date"], ["total_orders", "total_revenue"], id_col="summary_id",
                    table="sales_summary", as_of=as_of or _dt.datetime.now(), check_unique=False)
    replace_tables({"day_totals": totals, "sales_summary": merged}, target, applied_batch=str(batch_id))


def start_sales_summary_stream(orders: DataFrame, target: str, checkpoint: str, trigger_once: bool = True,
                               clock: Column | None = None, as_of=None, groups: int = ORDER_GROUPS):
    """Start T1.  Returns the StreamingQuery."""
    # the state function runs in Python workers
    ship_package(orders.sparkSession)
    w = (order_changes(orders, clock, groups).writeStream.outputMode("append")
         .foreachBatch(lambda batch, batch_id: apply_day_deltas(batch, batch_id, target, as_of))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def read_set_aside(spark: SparkSession, target: str) -> DataFrame:
    """Orders that T1 did not count: no usable date."""
    return spark.read.schema(ORDER_STATE + ", batch_id bigint").parquet(f"{target}/set_aside").drop("batch_id")


def read_sales_summary(spark: SparkSession, target: str) -> DataFrame:
    """The SALES_SUMMARY rows that T1 has merged so far."""
    return read_table(spark, f"{target}/sales_summary", "sales_summary").select(
        "summary_id", "summary_date", "total_orders", "total_revenue")


# --------------------------------------------------------------------------- T2
def daily_totals_stream(orders: DataFrame, lateness: str = "8 days", dedup: bool = False, distinct: bool = False) -> DataFrame:
    """Per-day orders and revenue over an order stream.

    ``distinct=True`` adds ``distinct_orders``, an approximate count (a sketch
    in the state) that works in update mode and counts a redelivered order once.

    ``dedup=True`` drops repeated order ids within the watermark first; the
    chained stateful operators then require append output mode.
    """
    # watermarks need a zoned timestamp: the wall-clock order date is read in
    # the session time zone (UTC in PLAN_CONF), and the day is taken back in it
    o = orders.withColumn("_event", F.col("order_date").cast("timestamp")).withWatermark("_event", lateness)
    if dedup:
        o = o.dropDuplicatesWithinWatermark(["order_id"])
    return (o.groupBy(F.window("_event", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("total_orders"), F.sum("total_amount").alias("revenue"),
                 *([F.approx_count_distinct("order_id", 0.01).alias("distinct_orders")] if distinct else []))
            .select(F.to_date(F.col("w.start")).alias("order_day"), "total_orders",
                    F.col("revenue").cast("decimal(38,2)").alias("revenue"), *(["distinct_orders"] if distinct else [])))


# --------------------------------------------------------------------------- T3
REQUEST_COLUMNS = ("seq", "product_id", "quantity")


def _decide(spark: SparkSession, root: str, ready: DataFrame, batch_id: int, others: dict[str, DataFrame], **notes: str) -> None:
    """Run ready requests through B7 against the stored stock and publish stock, ``others`` and notes together."""
    stock = read_table(spark, f"{root}/inventory", "inventory")
    after, decisions = reserve_inventory(stock, ready)
    decisions.write.mode("overwrite").parquet(f"{root}/decisions/batch_id={batch_id}")
    replace_tables({"inventory": after, **others}, root, applied_batch=str(batch_id), **notes)


def apply_request_batch(requests: DataFrame, batch_id: int, root: str, lag: int | None = None) -> None:
    """One micro-batch of T3: B7 against the stored stock; decisions go to the batch's own folder.

    A batch that was published already is skipped; one that failed before
    that finds the stock as it was and writes the same decisions again.

    Without ``lag`` the batches' requests must be in seq order.  With it, they
    may overlap: requests wait in the stored table ``held`` until a seq
    larger by ``lag`` has been seen, and are decided in seq order.  The buffer
    holds ``lag`` numbers at most and is published with the stock.  A request
    that comes again is dropped; one that comes after its number was passed is
    set aside (:func:`read_late_requests`), never decided out of order.
    """
    spark = requests.sparkSession
    done = note(spark, root, "applied_batch")
    if done is not None and int(done) >= batch_id:
        return
    rows = requests.select(*REQUEST_COLUMNS)
    if lag is None:
        _decide(spark, root, materialize(rows, "t3-batch"), batch_id, {})
        return
    passed = int(note(spark, root, "passed_seq") or -(1 << 62))
    path = f"{root}/held"
    held = spark.read.schema(REQUEST_STREAM_SCHEMA).parquet(current_path(spark, path)) if table_exists(spark, path) else \
        spark.createDataFrame([], REQUEST_STREAM_SCHEMA)
    # of a seq given twice, the smallest row: the same in a batch that is run again
    rows = rows.where("seq IS NOT NULL").unionByName(held).groupBy("seq").agg(
        F.min(F.struct("product_id", "quantity")).alias("r")).select("seq", "r.product_id", "r.quantity")
    rows = materialize(rows, "t3-waiting")
    late = rows.where(F.col("seq") <= passed)
    newest = rows.agg(F.max("seq")).first()[0]
    upto = passed if newest is None else max(passed, newest - lag)
    if not late.isEmpty():
        late = late.join(read_decisions(spark, root).select("seq").distinct(), "seq", "left_anti")
    late.write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
    ready = rows.where((F.col("seq") > passed) & (F.col("seq") <= upto))
    _decide(spark, root, ready, batch_id, {"held": rows.where(F.col("seq") > upto)}, passed_seq=str(upto))


def flush_requests(spark: SparkSession, root: str) -> None:
    """Decide the requests that still wait, as at the end of a stream; later ones with a smaller seq are late."""
    done = int(note(spark, root, "applied_batch") or -1)
    apply_request_batch(spark.createDataFrame([], REQUEST_STREAM_SCHEMA), done + 1, root, lag=0)


def start_reservation_stream(requests: DataFrame, root: str, checkpoint: str, trigger_once: bool = True, lag: int | None = None):
    """Decide a stream of requests(seq, product_id, quantity) against the stored ``<root>/inventory``.

    Without ``lag`` requests must arrive in seq order across batches.  Returns the StreamingQuery.
    """
    w = (requests.writeStream.foreachBatch(lambda batch, batch_id: apply_request_batch(batch, batch_id, root, lag))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def read_late_requests(spark: SparkSession, root: str) -> DataFrame:
    """Requests that came after their number was passed and are not decided, of all published batches."""
    done = int(note(spark, root, "applied_batch") or -1)
    rows = spark.read.schema(REQUEST_STREAM_SCHEMA + ", batch_id bigint").parquet(f"{root}/late")
    return rows.where(F.col("batch_id") <= done).drop("batch_id")


def read_decisions(spark: SparkSession, root: str) -> DataFrame:
    """The decisions of all published batches."""
    done = int(note(spark, root, "applied_batch") or -1)
    d = spark.read.schema("inventory_id bigint, seq bigint, product_id bigint, quantity bigint, accepted boolean, "
                          "batch_id bigint").parquet(f"{root}/decisions")
    return d.where(F.col("batch_id") <= done).drop("batch_id")
