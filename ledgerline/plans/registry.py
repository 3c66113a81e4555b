"""Name -> (spark, sf_dir) -> DataFrame for every registered query.

Every entry reads the given tables (through the shop mapping) over their
whole extent; request batches for the order-management operators are derived
from the same tables (see :mod:`ledgerline.plans.jobs`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import load_tables
from . import analytics as A
from . import jobs as J
from . import reports as R
from . import warehouse as W


def _on_tables(fn, **kw) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_tables(spark, sf_dir), **kw)
    run.__name__ = fn.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # analytical statements (Q1-Q9)
    "customer_order_detail": _on_tables(A.customer_order_detail),
    "customer_order_detail_per_order": _on_tables(A.customer_order_detail, dedup=True),
    "daily_sales": _on_tables(A.daily_sales),
    "daily_sales_per_order": _on_tables(A.daily_sales, dedup=True),
    "monthly_sales": _on_tables(A.monthly_sales),
    "customer_retention": _on_tables(A.customer_retention),
    "product_performance": _on_tables(A.product_performance),
    "executive_dashboard": _on_tables(A.executive_dashboard),
    "merge_sales_summary": _on_tables(W.merge_sales_summary_twice),
    "stored_sales_summary": _on_tables(W.stored_sales_summary),
    "merge_changes": _on_tables(W.merge_changes),
    "sketched_customers": _on_tables(J.sketched_customers_job),
    "streamed_sales_summary": _on_tables(J.streamed_sales_summary),
    "customer_activity": _on_tables(A.customer_activity),
    "sessions_by_user": _on_tables(A.sessions_by_user),
    # order-management operators on derived request batches
    "lookup_customers": _on_tables(J.lookup_customers_job),
    "lookup_products": _on_tables(J.lookup_products_job),
    "check_inventory": _on_tables(J.check_inventory_job),
    "loyalty_update": _on_tables(J.loyalty_update_job),
    "customer_kind": _on_tables(J.customer_kind_job),
    "payment_status": _on_tables(J.payment_status_job),
    "product_price": _on_tables(J.product_price_job),
    "restock_inventory": _on_tables(J.restock_job),
    "reserve_inventory": _on_tables(J.reserve_job),
    "reserve_decisions": _on_tables(J.reserve_decisions_job),
    "lookup_latest_orders": _on_tables(J.lookup_latest_orders_job),
    "price_orders": _on_tables(J.price_orders_job),
    "place_orders": _on_tables(J.place_orders_job),
    "placed_items": _on_tables(J.placed_items_job),
    "placed_payments": _on_tables(J.placed_payments_job),
    "placed_stock": _on_tables(J.placed_stock_job),
    "stored_place_orders": _on_tables(J.stored_place_orders_job),
    "stored_place_stock": _on_tables(J.stored_place_stock_job),
    "stored_payments": _on_tables(J.stored_payments_job),
    "stored_purge": _on_tables(J.stored_purge_job),
    "purge_old_orders": _on_tables(J.purge_job),
    "purged_orders": _on_tables(J.purged_orders_job),
    "purged_items": _on_tables(J.purged_items_job),
    "purged_transactions": _on_tables(J.purged_transactions_job),
    "process_payments": _on_tables(J.process_payments_job),
    "create_sessions": _on_tables(J.create_sessions_job),
    "end_idle_sessions": _on_tables(J.end_idle_sessions_job),
    "audit_loyalty": _on_tables(J.audit_loyalty_job),
    "constraint_report": _on_tables(J.constraint_report_job),
    "broken_constraint_report": _on_tables(J.broken_constraint_report_job),
    # report tier
    "top_products": _on_tables(R.top_products),
    "revenue_by_payment": _on_tables(R.revenue_by_payment),
    "customer_segmentation": _on_tables(R.customer_segmentation),
    "customer_ltv": _on_tables(R.customer_ltv),
    "purchase_frequency": _on_tables(R.purchase_frequency),
    "inventory_turnover": _on_tables(R.inventory_turnover),
    "slow_moving": _on_tables(R.slow_moving),
    "profit_margin": _on_tables(R.profit_margin),
    "affinity": _on_tables(R.affinity),
    "affinity_pairs": _on_tables(R.affinity_pairs),
    "revenue_growth": _on_tables(R.revenue_growth),
    "sales_report": _on_tables(R.sales_report),
    "inventory_report": _on_tables(R.inventory_report),
    "customer_report": _on_tables(R.customer_report),
    "transaction_report": _on_tables(R.transaction_report),
    "aggregate_customers": _on_tables(W.aggregate_customers_twice),
    "aggregate_products": _on_tables(W.aggregate_products_twice),
    "full_table_scan": _on_tables(R.full_table_scan),
}
