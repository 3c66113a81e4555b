"""Reusable set-based operators: upsert (U1), constraint checks (U2), surrogate
ids (U3), defaults (U4), change audit (U5), and the order-management steps
(B1-B19) with stock reservation (B7)."""

from .audit import audit_diff
from .constraints import constraint_report, constraint_violations
from .defaults import apply_defaults
from .ids import assign_ids, next_id, next_id_col
from .oltp import (add_order_items, apply_last_write, apply_loyalty_deltas, check_inventory, create_orders,
                   create_sessions, end_sessions, lookup_by_key, lookup_by_literals, lookup_customers, lookup_products, place_orders,
                   price_orders, process_transactions, purge_old_orders, record_transactions, restock_inventory,
                   set_customer_type, set_order_status, set_product_price)
from .reserve import reserve_inventory, running_sum
from .upsert import MergeError, upsert

__all__ = [
    "audit_diff", "constraint_report", "constraint_violations", "apply_defaults", "assign_ids", "next_id",
    "next_id_col", "add_order_items", "apply_last_write", "apply_loyalty_deltas", "check_inventory",
    "create_orders", "create_sessions", "end_sessions", "lookup_by_key", "lookup_by_literals", "lookup_customers", "lookup_products",
    "place_orders", "price_orders", "process_transactions", "purge_old_orders", "record_transactions",
    "restock_inventory", "set_customer_type", "set_order_status", "set_product_price", "reserve_inventory",
    "running_sum", "MergeError", "upsert",
]
