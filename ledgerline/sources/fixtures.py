"""Shop tables mapped from the driver's TPC-H-like parquet (FIXTURES.md §1).

Each mapping is one SQL text shared by both engines: Spark gets the raw tables
as DataFrame parameters of ``spark.sql`` (no session-wide views) and the
two-copies expansion as a generator instead of a join with a two-row
relation; DuckDB gets the raw view names and uses the texts as CTEs in the
oracle SQL.
All mappings are per-row projections (plus one group-by for sessions), so
they stay fused in the scan stage of every plan that uses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .raw import read_raw

# Clock shared by all order tests (max order date in the data is 2001-08-01).
AS_OF = "2001-08-01 12:00:00"
# Clock for session tests (events run 2024-01-01 .. 2024-01-30).
SESSION_AS_OF = "2024-01-31 00:00:00"

# Mapping texts; {name} marks a raw table.
FIXTURE_SQL: dict[str, str] = {
    "customers": """
SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
 concat('customer', CAST(c_custkey AS VARCHAR(20)), '@example.com') AS email,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'PREMIUM' WHEN 'MACHINERY' THEN 'VIP' ELSE 'REGULAR' END AS customer_type,
 concat('State', CAST(c_custkey % 50 AS VARCHAR(20))) AS state, CAST(floor(abs(c_acctbal)) AS BIGINT) AS loyalty_points
FROM {customer}""",
    "products": """
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS subcategory,
 CAST(p_retailprice AS DECIMAL(10,2)) AS price,
 CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(10,2)) AS cost,
 CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS is_active
FROM {part}""",
    "inventory": """
SELECT p_partkey * 2 + k AS inventory_id, p_partkey AS product_id,
 concat('WH-', CAST((p_partkey + k) % 5 AS VARCHAR(20))) AS warehouse_location,
 1000 + (p_partkey * 137) % 5000 AS quantity_available, CAST(0 AS BIGINT) AS quantity_reserved,
 CAST(100 AS BIGINT) AS reorder_level
FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks
WHERE p_partkey % 20 <> 0 AND (k = 0 OR p_partkey % 7 = 0)""",
    "shop_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
 CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'SHIPPED' ELSE 'PENDING' END AS status,
 CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS total_amount,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CREDIT_CARD' WHEN '2-HIGH' THEN 'PAYPAL' ELSE 'BANK_TRANSFER' END AS payment_method
FROM {orders}""",
    "order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
 CAST(CAST(CAST(((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
   - (2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) % (2 * CAST(l_quantity AS BIGINT)))
   / (2 * CAST(l_quantity AS BIGINT)) AS BIGINT) AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS unit_price,
 CAST(l_discount AS DECIMAL(8,2)) AS discount, CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal
FROM {lineitem}""",
    "transactions": """
SELECT o_orderkey * 2 + k AS transaction_id, o_orderkey AS order_id, 'PAYMENT' AS transaction_type,
 CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
 CASE o_orderkey % 3 WHEN 0 THEN 'STRIPE' WHEN 1 THEN 'PAYPAL' ELSE 'SQUARE' END AS payment_gateway,
 CASE WHEN k = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, o_orderdate AS processed_at
FROM {orders} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks
WHERE o_orderkey % 10 <> 0 AND (k = 0 OR o_orderkey % 7 = 0)""",
    "session_data": """
SELECT concat(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS session_id,
 user_id AS customer_id, min(ts) AS login_time, max(ts) AS last_activity,
 CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-30' THEN 1 ELSE 0 END AS is_active
FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
}

# Raw tables each mapping reads.
_SOURCES = {
    "customers": ("customer",), "products": ("part",), "inventory": ("part",),
    "shop_orders": ("orders",), "order_items": ("lineitem",), "transactions": ("orders",),
    "session_data": ("events",),
}

# Shop-table name -> key used in the table dict handed to every plan.
TABLE_KEYS = {
    "customers": "customers", "products": "products", "inventory": "inventory",
    "shop_orders": "orders", "order_items": "order_items", "transactions": "transactions",
    "session_data": "sessions",
}


# Spark form of the two-copies expansion: a generator instead of a join with a
# two-row relation (same rows; the DuckDB oracle keeps the CROSS JOIN text).
_TWO_COPIES_SQL = "CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks"
_TWO_COPIES_SPARK = "LATERAL VIEW explode(array(0, 1)) ks AS k"


def shop_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shop table mapped from the raw parquet of ``sf_dir`` (lazy)."""
    raw = {r: read_raw(spark, sf_dir, r) for r in _SOURCES[name]}
    return spark.sql(FIXTURE_SQL[name].replace(_TWO_COPIES_SQL, _TWO_COPIES_SPARK), **raw)


class ShopTables(dict):
    """Lazy dict of shop tables keyed orders, order_items, customers, ...

    Only tables a plan touches are built (each is just a lazy DataFrame).
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, key):
        for name, k in TABLE_KEYS.items():
            if k == key:
                df = shop_table(self._spark, self._dir, name)
                self[key] = df
                return df
        raise KeyError(key)


def load_tables(spark: SparkSession, sf_dir: str) -> ShopTables:
    """The OLTP tables over one data folder, as the folder stands now.

    Nothing is kept between calls, so files added or replaced since an
    earlier call are seen.
    """
    return ShopTables(spark, sf_dir)


def cte_prefix(names: list[str]) -> str:
    """``WITH a AS (...), b AS (...)`` for the DuckDB oracle (raw views are registered)."""
    parts = []
    for n in names:
        body = FIXTURE_SQL[n].format(**{r: r for r in _SOURCES[n]})
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
