"""Plan properties that must hold for every registered query (the scale review, codified)."""

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL

from ledgerline.plans.registry import QUERIES

CLOCK_QUERIES = ["customer_order_detail", "daily_sales", "monthly_sales", "customer_retention",
                 "executive_dashboard", "customer_activity", "top_products",
                 "revenue_by_payment", "customer_segmentation", "profit_margin", "revenue_growth", "sales_report"]


def _formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_cartesian_or_python(spark, name):
    plan = _formatted(QUERIES[name](spark, SF_SMALL))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)


@pytest.mark.parametrize("name", CLOCK_QUERIES)
def test_clock_bound_reaches_the_scan(spark, name):
    plan = _formatted(QUERIES[name](spark, SF_SMALL))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan)
    assert any("o_orderdate" in p and ("GreaterThan" in p or "LessThan" in p) for p in pushed), name


def test_scans_read_only_needed_columns(spark):
    plan = _formatted(QUERIES["monthly_sales"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert schemas and all("o_orderpriority" not in s and "o_custkey" not in s for s in schemas)


def test_rollup_clock_bound_reaches_the_scan(spark):
    """The merge stages its join, so its source is looked at instead."""
    from ledgerline.plans.warehouse import sales_rollup
    from ledgerline.sources import load_tables
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", _formatted(sales_rollup(load_tables(spark, SF_SMALL))))
    assert any("o_orderdate" in p and "GreaterThan" in p for p in pushed)


def test_numbering_has_no_single_partition_window_over_rows(spark):
    """Ids come from ranges of sorted partitions at every size; only per-partition counts meet in one task."""
    from ledgerline.operators.ids import assign_ids
    plan = _formatted(assign_ids(spark.range(10).toDF("k"), ["k"]))
    assert plan.count("Exchange SinglePartition") <= 1 and "row_number" not in plan


def test_merge_reads_orders_twice_for_two_runs(spark):
    """Rows read from the raw orders by two rollup runs and their merges: two scans, no more."""
    from pyspark.sql import functions as F

    from ledgerline.plans.warehouse import merge_sales_summary_twice
    from ledgerline.sources import load_tables
    t = load_tables(spark, SF_SMALL)
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    o = t["orders"].select(*[F.col(c).cast("string") if c == "order_date" else F.col(c) for c in t["orders"].columns])
    n = o.count()
    t["orders"] = o.mapInArrow(watch, o.schema).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
    merge_sales_summary_twice(t).count()
    assert seen.value <= 2 * n
