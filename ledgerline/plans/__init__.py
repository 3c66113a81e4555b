"""Analytical statements (Q1-Q9), rollup merges, the report tier, and the
registered runs of the order-management operators."""

from .analytics import (customer_activity, customer_order_detail, customer_retention, daily_sales,
                        executive_dashboard, monthly_sales, product_performance, sessions_by_user)
from .reports import (affinity, customer_ltv, customer_report, customer_segmentation, full_table_scan,
                      inventory_report, inventory_turnover, profit_margin, purchase_frequency, revenue_by_payment,
                      revenue_growth, sales_report, slow_moving, top_products, transaction_report)
from .warehouse import (aggregate_customers, aggregate_products, merge_sales_summary, sales_rollup)

__all__ = [
    "customer_activity", "customer_order_detail", "customer_retention", "daily_sales", "executive_dashboard",
    "monthly_sales", "product_performance", "sessions_by_user", "affinity", "customer_ltv", "customer_report",
    "customer_segmentation", "full_table_scan", "inventory_report", "inventory_turnover", "profit_margin",
    "purchase_frequency", "revenue_by_payment", "revenue_growth", "sales_report", "slow_moving", "top_products",
    "transaction_report", "aggregate_customers", "aggregate_products", "merge_sales_summary", "sales_rollup",
]
