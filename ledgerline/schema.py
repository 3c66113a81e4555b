"""Explicit schemas of the retail tables and their column defaults.

Types follow the DDL: keys and counts are BIGINT, flags INT 0/1, money
DECIMAL(p,s) with the DDL's precision, timestamps without zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, TS, D = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType(), T.DateType()


def Dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Full DDL layout of every table (column order as declared).
SCHEMAS: dict[str, T.StructType] = {
    "customers": _st(("customer_id", L), ("first_name", S), ("last_name", S), ("email", S), ("phone", S),
                     ("address", S), ("city", S), ("state", S), ("zip_code", S), ("country", S),
                     ("created_at", TS), ("updated_at", TS), ("loyalty_points", L), ("customer_type", S)),
    "products": _st(("product_id", L), ("product_name", S), ("category", S), ("subcategory", S),
                    ("description", S), ("price", Dec(10, 2)), ("cost", Dec(10, 2)), ("weight", Dec(10, 3)),
                    ("dimensions", S), ("manufacturer", S), ("sku", S), ("created_at", TS), ("is_active", I)),
    "inventory": _st(("inventory_id", L), ("product_id", L), ("warehouse_location", S),
                     ("quantity_available", L), ("quantity_reserved", L), ("reorder_level", L),
                     ("last_restock_date", TS), ("updated_at", TS)),
    "orders": _st(("order_id", L), ("customer_id", L), ("order_date", TS), ("status", S),
                  ("total_amount", Dec(12, 2)), ("tax_amount", Dec(10, 2)), ("shipping_cost", Dec(8, 2)),
                  ("payment_method", S), ("shipping_address", S), ("tracking_number", S), ("created_at", TS),
                  ("updated_at", TS)),
    "order_items": _st(("order_item_id", L), ("order_id", L), ("product_id", L), ("quantity", L),
                       ("unit_price", Dec(10, 2)), ("discount", Dec(8, 2)), ("subtotal", Dec(12, 2))),
    "transactions": _st(("transaction_id", L), ("order_id", L), ("transaction_type", S),
                        ("amount", Dec(12, 2)), ("currency", S), ("payment_gateway", S),
                        ("gateway_transaction_id", S), ("status", S), ("processed_at", TS),
                        ("error_message", S)),
    "audit_log": _st(("audit_id", L), ("table_name", S), ("operation", S), ("record_id", L),
                     ("old_value", S), ("new_value", S), ("changed_by", S), ("changed_at", TS)),
    "sessions": _st(("session_id", S), ("customer_id", L), ("login_time", TS), ("last_activity", TS),
                    ("ip_address", S), ("user_agent", S), ("session_data", S), ("is_active", I)),
    "sales_summary": _st(("summary_id", L), ("summary_date", D), ("total_orders", L),
                         ("total_revenue", Dec(15, 2)), ("total_customers", L),
                         ("avg_order_value", Dec(10, 2)), ("created_at", TS)),
    "customer_analytics": _st(("analytics_id", L), ("customer_id", L), ("total_orders", L),
                              ("total_spent", Dec(12, 2)), ("avg_order_value", Dec(10, 2)),
                              ("last_order_date", TS), ("customer_segment", S), ("calculated_at", TS)),
    "product_performance": _st(("performance_id", L), ("product_id", L), ("period_start", D),
                               ("period_end", D), ("units_sold", L), ("revenue", Dec(12, 2)),
                               ("profit", Dec(12, 2)), ("return_count", L), ("calculated_at", TS)),
}

# Column DEFAULTs from the DDL.  "NOW" means the job clock (as_of).
DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"created_at": "NOW", "updated_at": "NOW", "loyalty_points": 0, "customer_type": "REGULAR"},
    "products": {"created_at": "NOW", "is_active": 1},
    "inventory": {"quantity_reserved": 0, "updated_at": "NOW"},
    "orders": {"order_date": "NOW", "created_at": "NOW", "updated_at": "NOW"},
    "order_items": {"discount": 0},
    "transactions": {"currency": "USD", "processed_at": "NOW"},
    "audit_log": {"changed_at": "NOW"},
    "sessions": {"is_active": 1},
    "sales_summary": {"created_at": "NOW"},
    "customer_analytics": {"calculated_at": "NOW"},
    "product_performance": {"calculated_at": "NOW"},
}

# Keys and constraints from the DDL.
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",), "products": ("product_id",), "inventory": ("inventory_id",),
    "orders": ("order_id",), "order_items": ("order_item_id",), "transactions": ("transaction_id",),
    "audit_log": ("audit_id",), "sessions": ("session_id",), "sales_summary": ("summary_id",),
    "customer_analytics": ("analytics_id",), "product_performance": ("performance_id",),
}
UNIQUE_KEYS: dict[str, tuple[str, ...]] = {"customers": ("email",), "products": ("sku",)}
NOT_NULL: dict[str, tuple[str, ...]] = {
    "customers": ("first_name", "last_name", "email"),
    "products": ("product_name", "price"),
    "inventory": ("product_id", "quantity_available"),
    "orders": ("customer_id", "status"),
    "order_items": ("order_id", "product_id", "quantity", "unit_price"),
    "transactions": ("order_id",),
}
# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("inventory", "product_id", "products", "product_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("transactions", "order_id", "orders", "order_id"),
]
