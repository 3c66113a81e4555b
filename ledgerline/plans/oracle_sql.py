"""DuckDB twins of the registered queries (correctness oracle).

Each text states the result described in SURVEY §2 in a formulation of its
own, run on the raw driver tables with the shop mapping inlined as CTEs.
Result columns are cast to the same types the Spark plans produce.
"""

from __future__ import annotations

from ..sources.fixtures import AS_OF, SESSION_AS_OF, cte_prefix

TS = f"TIMESTAMP '{AS_OF}'"
STS = f"TIMESTAMP '{SESSION_AS_OF}'"


def _q(tables: list[str], body: str) -> str:
    return cte_prefix(tables) + body


ORACLE: dict[str, str] = {}

ORACLE["monthly_sales"] = _q(["shop_orders"], f"""
SELECT strftime(o.order_date, '%Y-%m') AS order_month, COUNT(DISTINCT o.order_id) AS total_orders,
       CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS revenue
FROM shop_orders o
WHERE o.order_date >= {TS} - INTERVAL 12 MONTH
GROUP BY strftime(o.order_date, '%Y-%m')
ORDER BY order_month DESC""")

ORACLE["daily_sales"] = _q(["shop_orders", "order_items"], f"""
SELECT CAST(o.order_date AS DATE) AS order_day, COUNT(DISTINCT o.order_id) AS total_orders,
       CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS revenue
FROM shop_orders o JOIN order_items oi ON o.order_id = oi.order_id
WHERE o.order_date >= {TS} - INTERVAL 30 DAY
GROUP BY CAST(o.order_date AS DATE)
ORDER BY order_day DESC""")

ORACLE["daily_sales_per_order"] = _q(["shop_orders", "order_items"], f"""
SELECT CAST(o.order_date AS DATE) AS order_day, COUNT(*) AS total_orders,
       CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS revenue
FROM shop_orders o
WHERE o.order_date >= {TS} - INTERVAL 30 DAY
  AND EXISTS (SELECT 1 FROM order_items oi WHERE oi.order_id = o.order_id)
GROUP BY CAST(o.order_date AS DATE)
ORDER BY order_day DESC""")

ORACLE["customer_retention"] = _q(["shop_orders"], f""",
active AS (
  SELECT DISTINCT customer_id AS who, date_trunc('month', order_date) AS m
  FROM shop_orders WHERE order_date >= {TS} - INTERVAL 12 MONTH),
came_back AS (
  SELECT m, (who, m + INTERVAL 1 MONTH) IN (SELECT (who, CAST(m AS TIMESTAMP)) FROM active) AS again FROM active),
counted AS (
  SELECT m, COUNT(*) AS n, COUNT(*) FILTER (WHERE again) AS k FROM came_back GROUP BY m)
SELECT strftime(m, '%Y-%m') AS month, n AS customers_this_month, k AS customers_next_month,
       CAST(CAST((20000 * k + n) // NULLIF(2 * n, 0) AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2))
         AS retention_rate
FROM counted ORDER BY m DESC""")

ORACLE["product_performance"] = _q(["products", "order_items", "shop_orders"], f"""
SELECT p.product_id, p.product_name, p.category,
       CAST(COALESCE(SUM(oi.quantity), 0) AS BIGINT) AS total_units_sold,
       CAST(COALESCE(SUM(oi.subtotal), 0) AS DECIMAL(38,2)) AS total_revenue
FROM products p
LEFT JOIN order_items oi ON p.product_id = oi.product_id
LEFT JOIN shop_orders o ON oi.order_id = o.order_id AND o.order_date >= {TS} - INTERVAL 90 DAY
WHERE p.is_active = 1
GROUP BY p.product_id, p.product_name, p.category
ORDER BY total_revenue DESC, p.product_id""")

ORACLE["executive_dashboard"] = _q(["shop_orders"], f"""
SELECT 'Orders' AS metric,
  CAST((SELECT COUNT(*) FROM shop_orders WHERE CAST(order_date AS DATE) = CAST({TS} AS DATE)) AS DECIMAL(38,0)) AS today_count,
  CAST((SELECT COUNT(*) FROM shop_orders WHERE CAST(order_date AS DATE) = CAST({TS} - INTERVAL 1 DAY AS DATE)) AS DECIMAL(38,0)) AS yesterday_count
UNION ALL
SELECT 'Revenue' AS metric,
  CAST(ROUND((SELECT SUM(total_amount) FROM shop_orders WHERE CAST(order_date AS DATE) = CAST({TS} AS DATE)), 0) AS DECIMAL(38,0)),
  CAST(ROUND((SELECT SUM(total_amount) FROM shop_orders WHERE CAST(order_date AS DATE) = CAST({TS} - INTERVAL 1 DAY AS DATE)), 0) AS DECIMAL(38,0))""")

ORACLE["customer_activity"] = _q(["customers", "shop_orders", "order_items"], f"""
SELECT c.customer_id, concat(c.first_name, ' ', c.last_name) AS customer_name,
       COUNT(DISTINCT o.order_id) AS order_count, CAST(SUM(oi.quantity) AS BIGINT) AS total_items
FROM customers c
LEFT JOIN shop_orders o ON c.customer_id = o.customer_id
LEFT JOIN order_items oi ON o.order_id = oi.order_id
WHERE o.order_date >= {TS} - INTERVAL 90 DAY
GROUP BY c.customer_id, c.first_name, c.last_name
ORDER BY c.customer_id
LIMIT 100""")

ORACLE["sessions_by_user"] = _q(["session_data", "customers"], """
SELECT c.customer_type, COUNT(*) AS session_count, CAST(SUM(s.is_active) AS BIGINT) AS active_sessions
FROM session_data s JOIN customers c ON s.customer_id = c.customer_id
WHERE c.customer_type IN ('PREMIUM', 'VIP')
GROUP BY c.customer_type""")

_RECENCY = f"""CASE WHEN order_date < {TS} - INTERVAL 6 MONTH THEN 'OLD'
       WHEN order_date < {TS} - INTERVAL 1 MONTH THEN 'MODERATE' ELSE 'RECENT' END"""


def _value(v: str) -> str:
    return f"CASE WHEN {v} >= 1000 THEN 'HIGH_VALUE' WHEN {v} >= 500 THEN 'MEDIUM_VALUE' ELSE 'LOW_VALUE' END"


def _order_detail(per_row: bool) -> str:
    """Q1: how often each order appears, totals and ranks from those counts, and the lines of the first orders.

    ``per_row`` counts joined rows (as the statement does), else orders.
    """
    times = "l.copies * greatest(COALESCE(y.n, 0), 1)" if per_row else "1"
    return _q(["customers", "shop_orders", "order_items", "products", "inventory", "transactions"], f""",
stock AS (SELECT product_id, COUNT(*) AS n FROM inventory GROUP BY product_id),
paid AS (SELECT order_id, COUNT(*) AS n FROM transactions GROUP BY order_id),
line_count AS (
  SELECT i.order_id, SUM(COALESCE(s.n, 1)) AS copies FROM order_items i LEFT JOIN stock s USING (product_id)
  WHERE i.product_id IN (SELECT product_id FROM products) GROUP BY i.order_id),
seen AS (
  SELECT o.order_id, o.customer_id, o.order_date, o.total_amount, {times} AS times
  FROM shop_orders o JOIN line_count l USING (order_id) LEFT JOIN paid y USING (order_id)
  WHERE o.order_date >= {TS} - INTERVAL 24 MONTH AND o.customer_id IN (SELECT customer_id FROM customers)),
per_customer AS (
  SELECT customer_id, SUM(times) AS n, SUM(total_amount * times) AS v FROM seen GROUP BY customer_id),
ranked AS (
  SELECT a.order_id, 1 + COALESCE((SELECT SUM(b.times) FROM seen b
                                   WHERE b.customer_id = a.customer_id AND b.order_date > a.order_date), 0) AS place
  FROM seen a)
SELECT o.customer_id, concat(c.first_name, ' ', c.last_name) AS customer_name, c.email, c.customer_type, c.loyalty_points,
  CAST(pc.n AS BIGINT) AS customer_total_orders, CAST(pc.v AS DECIMAL(38,2)) AS customer_lifetime_value,
  CAST(r.place AS BIGINT) AS customer_order_rank, o.order_id, o.order_date, o.status AS order_status,
  o.total_amount AS order_total, o.payment_method, i.product_id, p.product_name, p.category AS product_category, i.quantity,
  i.unit_price, i.subtotal, w.quantity_available AS inventory_available, t.transaction_id, t.status AS transaction_status,
  t.payment_gateway, {_RECENCY} AS order_recency, {_value("pc.v")} AS customer_value_segment
FROM ranked r JOIN shop_orders o USING (order_id) JOIN per_customer pc USING (customer_id) JOIN customers c USING (customer_id)
  JOIN order_items i USING (order_id) JOIN products p USING (product_id)
  LEFT JOIN inventory w USING (product_id) LEFT JOIN transactions t USING (order_id)
ORDER BY o.customer_id, o.order_date DESC, i.subtotal DESC NULLS FIRST, o.order_id, i.product_id, i.quantity, i.unit_price,
  w.inventory_id NULLS LAST, t.transaction_id NULLS LAST
LIMIT 500""")


ORACLE["customer_order_detail"] = _order_detail(True)
ORACLE["customer_order_detail_per_order"] = _order_detail(False)


# --------------------------------------------------------------------------- helpers
def _rec(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _hu(num: str, den: str, scale: int = 2, den_scale: int = 0) -> str:
    """num/den rounded half away from zero to ``scale`` digits, in exact HUGEINT arithmetic.

    ``num * 10^(scale+den_scale)`` and ``den * 10^den_scale`` must be whole numbers.
    """
    n = f"CAST(({num}) * {10 ** (scale + den_scale)} AS HUGEINT)"
    d = f"CAST(({den}) * {10 ** den_scale} AS HUGEINT)"
    q = f"((2 * abs({n}) + abs({d})) // (2 * abs({d})))"
    signed = f"(CASE WHEN (({n}) < 0) <> (({d}) < 0) THEN -{q} ELSE {q} END)"
    return (f"(CASE WHEN ({d}) <> 0 THEN CAST({signed} AS DECIMAL(38,0)) * "
            f"CAST('1E-{scale}' AS DECIMAL({scale + 1},{scale})) END)")


def _ts_minus_days(days: int, base: str = TS) -> str:
    return f"{base} - INTERVAL {days} DAY"


def _draw(col: str, seed: int, n: int) -> str:
    """A repeatable number in 0..n-1 keyed by a column."""
    return f"(('0x' || substr(md5('{seed}|' || CAST({col} AS VARCHAR)), 1, 8))::BIGINT % {n})"


TS_EARLY3 = "TIMESTAMP '2001-07-29 12:00:00'"   # as_of - 3 days
TS_EARLY30 = "TIMESTAMP '2001-07-02 12:00:00'"  # as_of - 30 days

# --------------------------------------------------------------------------- B ops
ORACLE["lookup_customers"] = _q(["shop_orders", "customers"], f"""
SELECT ids.customer_id, c.first_name, c.last_name, c.email, c.customer_type, c.loyalty_points
FROM (SELECT DISTINCT customer_id FROM shop_orders WHERE order_date >= {_ts_minus_days(7)}) ids
LEFT JOIN customers c ON ids.customer_id = c.customer_id""")

_RECENT_PIDS = f"""(SELECT DISTINCT oi.product_id FROM order_items oi JOIN shop_orders o ON oi.order_id = o.order_id
  WHERE o.order_date >= {_ts_minus_days(7)})"""

ORACLE["lookup_products"] = _q(["shop_orders", "order_items", "products"], f"""
SELECT ids.product_id, p.product_name, p.category, p.subcategory, p.price, p.cost, p.is_active
FROM {_RECENT_PIDS} ids LEFT JOIN products p ON ids.product_id = p.product_id""")

ORACLE["check_inventory"] = _q(["shop_orders", "order_items", "inventory"], f"""
SELECT ids.product_id, CAST(COALESCE(s.q, 0) AS BIGINT) AS quantity_available
FROM {_RECENT_PIDS} ids
LEFT JOIN (SELECT product_id, SUM(quantity_available) AS q FROM inventory GROUP BY product_id) s
  ON ids.product_id = s.product_id""")

_LOYALTY = f"""(SELECT customer_id, SUM(CAST(floor(total_amount / 10) AS BIGINT)) AS d FROM shop_orders
  WHERE order_date >= {_ts_minus_days(30)} GROUP BY customer_id)"""

ORACLE["loyalty_update"] = _q(["customers", "shop_orders"], f"""
SELECT c.customer_id, c.first_name, c.last_name, c.email, c.customer_type, c.state,
  CAST(CASE WHEN d.d IS NULL THEN c.loyalty_points ELSE c.loyalty_points + d.d END AS BIGINT) AS loyalty_points
FROM customers c LEFT JOIN {_LOYALTY} d ON c.customer_id = d.customer_id""")

ORACLE["audit_loyalty"] = _q(["customers", "shop_orders"], f""",
ba AS (
  SELECT c.customer_id,
    to_json(struct_pack(customer_type := c.customer_type, loyalty_points := c.loyalty_points)) AS old_value,
    to_json(struct_pack(customer_type := c.customer_type, loyalty_points := CAST(
      CASE WHEN d.d IS NULL THEN c.loyalty_points ELSE c.loyalty_points + d.d END AS BIGINT))) AS new_value
  FROM customers c LEFT JOIN {_LOYALTY} d ON c.customer_id = d.customer_id)
SELECT ROW_NUMBER() OVER (ORDER BY customer_id, 'UPDATE') AS audit_id, 'CUSTOMERS' AS table_name,
  'UPDATE' AS operation, customer_id AS record_id, CAST(old_value AS VARCHAR) AS old_value,
  CAST(new_value AS VARCHAR) AS new_value, 'ledgerline' AS changed_by, {TS} AS changed_at
FROM ba WHERE CAST(old_value AS VARCHAR) <> CAST(new_value AS VARCHAR)""")

ORACLE["restock_inventory"] = _q(["inventory", "order_items", "shop_orders"], f"""
SELECT i.inventory_id, i.product_id, i.warehouse_location,
  CAST(i.quantity_available + COALESCE(d.d, 0) AS BIGINT) AS quantity_available, i.quantity_reserved, i.reorder_level
FROM inventory i LEFT JOIN (
  SELECT oi.product_id, SUM(oi.quantity) AS d FROM order_items oi JOIN shop_orders o ON oi.order_id = o.order_id
  WHERE o.order_date >= {_ts_minus_days(30)} GROUP BY oi.product_id) d ON i.product_id = d.product_id""")

def _reservation(requests: str, stock: str, result: str, tables: list[str]) -> str:
    """Requests (seq, product_id, quantity) folded in order into every row of ``stock``."""
    return _rec(_q(tables, f""",
{requests},
scarce AS (SELECT inventory_id, product_id, {stock} AS quantity_available, quantity_reserved FROM inventory),
inv_req AS (SELECT i.inventory_id, r.seq, r.quantity, ROW_NUMBER() OVER (PARTITION BY i.inventory_id ORDER BY r.seq) AS k
            FROM scarce i JOIN req r ON i.product_id = r.product_id),
fold AS (
  SELECT inventory_id, CAST(0 AS BIGINT) AS k, CAST(quantity_available AS BIGINT) AS avail, CAST(0 AS BIGINT) AS taken,
         false AS ok FROM scarce
  UNION ALL
  SELECT f.inventory_id, f.k + 1, f.avail - CASE WHEN f.avail >= r.quantity THEN r.quantity ELSE 0 END,
         f.taken + CASE WHEN f.avail >= r.quantity THEN r.quantity ELSE 0 END, f.avail >= r.quantity
  FROM fold f JOIN inv_req r ON r.inventory_id = f.inventory_id AND r.k = f.k + 1),
fin AS (SELECT inventory_id, arg_max(avail, k) AS avail, arg_max(taken, k) AS taken FROM fold GROUP BY inventory_id)
{result}"""))


_LINE_REQ = """req AS (SELECT ROW_NUMBER() OVER (ORDER BY order_id, product_id, quantity, unit_price, subtotal) AS seq,
               product_id, quantity FROM order_items)"""
_STOCK_AFTER = """SELECT i.inventory_id, i.product_id, CAST(f.avail AS BIGINT) AS quantity_available,
       CAST(i.quantity_reserved + f.taken AS BIGINT) AS quantity_reserved
FROM scarce i JOIN fin f ON i.inventory_id = f.inventory_id"""

ORACLE["reserve_inventory"] = _reservation(_LINE_REQ, "quantity_available % 60", _STOCK_AFTER, ["inventory", "order_items"])

ORACLE["reserve_decisions"] = _reservation(_LINE_REQ, "quantity_available % 60", """
SELECT q.inventory_id, q.seq, i.product_id, q.quantity, f.ok AS accepted
FROM inv_req q JOIN fold f ON f.inventory_id = q.inventory_id AND f.k = q.k JOIN scarce i ON i.inventory_id = q.inventory_id""",
                                           ["inventory", "order_items"])

ORACLE["lookup_latest_orders"] = _q(["shop_orders"], """
SELECT * FROM shop_orders QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) = 1""")

_PRICE = """CAST(COALESCE(s.s, 0) AS DECIMAL(38,2)) AS items_total,
  CAST(COALESCE(s.s, 0) * CAST(0.08 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS tax_amount,
  CAST(CASE WHEN COALESCE(s.s, 0) > 100 THEN 0 ELSE 10 END AS DECIMAL(8,2)) AS shipping_cost,
  CAST(COALESCE(s.s, 0) + COALESCE(s.s, 0) * CAST(0.08 AS DECIMAL(3,2))
       + CASE WHEN COALESCE(s.s, 0) > 100 THEN 0 ELSE 10 END AS DECIMAL(12,2)) AS total_amount"""

ORACLE["price_orders"] = _q(["shop_orders", "order_items"], f"""
SELECT o.order_id, {_PRICE}
FROM shop_orders o LEFT JOIN (SELECT order_id, SUM(quantity * unit_price) AS s FROM order_items GROUP BY order_id) s
  ON o.order_id = s.order_id""")

ORACLE["place_orders"] = _q(["shop_orders", "order_items", "products"], f""",
req AS (SELECT order_id AS request_id, customer_id, payment_method FROM shop_orders
        WHERE order_date >= {_ts_minus_days(7)}),
newo AS (SELECT (SELECT MAX(order_id) FROM shop_orders) + ROW_NUMBER() OVER (ORDER BY request_id) AS order_id,
                request_id, customer_id, COALESCE(payment_method, 'CREDIT_CARD') AS payment_method FROM req),
s AS (SELECT oi.order_id AS request_id, SUM(oi.quantity * CAST(p.price AS DECIMAL(10,2))) AS s
      FROM order_items oi JOIN req ON oi.order_id = req.request_id JOIN products p ON oi.product_id = p.product_id
      GROUP BY oi.order_id),
priced AS (SELECT n.order_id, n.customer_id, n.payment_method, {_PRICE}
           FROM newo n LEFT JOIN s ON n.request_id = s.request_id)
SELECT order_id, customer_id, {TS} AS order_date, 'COMPLETED' AS status, total_amount, tax_amount, shipping_cost,
       payment_method FROM priced""")

_PLACED_ITEMS = f"""wanted AS (
  SELECT order_id AS request_id, (SELECT MAX(order_id) FROM shop_orders) + ROW_NUMBER() OVER (ORDER BY order_id) AS order_id
  FROM shop_orders WHERE order_date >= {_ts_minus_days(7)}),
placed AS (
  SELECT w.order_id, w.request_id, oi.product_id, oi.quantity, oi.subtotal
  FROM wanted w JOIN order_items oi ON oi.order_id = w.request_id),
numbered AS (
  SELECT ROW_NUMBER() OVER (ORDER BY request_id, x.product_id, quantity, subtotal) AS order_item_id, x.order_id, x.product_id,
         CAST(quantity AS BIGINT) AS quantity, CAST(p.price AS DECIMAL(10,2)) AS unit_price
  FROM placed x JOIN products p ON x.product_id = p.product_id)"""

ORACLE["placed_items"] = _q(["shop_orders", "order_items", "products"], f""",
{_PLACED_ITEMS}
SELECT order_item_id, order_id, product_id, quantity, unit_price, CAST(quantity * unit_price AS DECIMAL(12,2)) AS subtotal
FROM numbered""")

ORACLE["placed_payments"] = _q(["shop_orders", "order_items", "products", "transactions"], f""",
req AS (SELECT order_id AS request_id FROM shop_orders WHERE order_date >= {_ts_minus_days(7)}),
newo AS (SELECT (SELECT MAX(order_id) FROM shop_orders) + ROW_NUMBER() OVER (ORDER BY request_id) AS order_id, request_id FROM req),
s AS (SELECT oi.order_id AS request_id, SUM(oi.quantity * CAST(p.price AS DECIMAL(10,2))) AS s
      FROM order_items oi JOIN req ON oi.order_id = req.request_id JOIN products p ON oi.product_id = p.product_id
      GROUP BY oi.order_id),
priced AS (SELECT n.order_id, {_PRICE} FROM newo n LEFT JOIN s ON n.request_id = s.request_id)
SELECT (SELECT MAX(transaction_id) FROM transactions) + ROW_NUMBER() OVER (ORDER BY order_id) AS transaction_id, order_id,
       total_amount AS amount, 'STRIPE' AS payment_gateway, 'COMPLETED' AS status FROM priced""")

ORACLE["placed_stock"] = _reservation(
    _PLACED_ITEMS + ",\nreq AS (SELECT order_item_id AS seq, product_id, quantity FROM numbered)", "quantity_available % 60",
    _STOCK_AFTER, ["inventory", "order_items", "shop_orders", "products"])

ORACLE["payment_status"] = _q(["shop_orders", "transactions"], """
SELECT o.order_id, CASE WHEN w.order_id IS NULL THEN o.status ELSE w.status END AS status
FROM shop_orders o LEFT JOIN (
  SELECT order_id, arg_max(CASE WHEN status = 'COMPLETED' THEN 'PAID' ELSE 'PAYMENT_FAILED' END, transaction_id) AS status
  FROM transactions GROUP BY order_id) w ON o.order_id = w.order_id""")

ORACLE["customer_kind"] = _q(["customers", "shop_orders"], """
SELECT c.customer_id, CASE WHEN w.customer_id IS NULL THEN c.customer_type ELSE w.t END AS customer_type
FROM customers c LEFT JOIN (
  SELECT customer_id, arg_max(CASE WHEN total_amount >= 200000 THEN 'VIP' ELSE 'REGULAR' END, order_id) AS t
  FROM shop_orders GROUP BY customer_id) w ON c.customer_id = w.customer_id""")

ORACLE["product_price"] = _q(["products", "order_items"], """
SELECT p.product_id, CASE WHEN w.product_id IS NULL THEN p.price ELSE CAST(w.v AS DECIMAL(10,2)) END AS price
FROM products p LEFT JOIN (
  SELECT product_id, max(struct_pack(s := order_id, v := unit_price)).v AS v FROM order_items GROUP BY product_id) w
  ON p.product_id = w.product_id""")

ORACLE["purge_old_orders"] = _q(["shop_orders", "order_items", "transactions"], f""",
doomed AS (SELECT order_id FROM shop_orders
           WHERE status IN ('COMPLETED', 'DELIVERED') AND order_date < {_ts_minus_days(90)}),
c AS (
  SELECT 'orders' AS table_name, (SELECT COUNT(*) FROM shop_orders) AS rows_before,
         (SELECT COUNT(*) FROM shop_orders x WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.order_id = x.order_id)) AS rows_after
  UNION ALL
  SELECT 'order_items', (SELECT COUNT(*) FROM order_items),
         (SELECT COUNT(*) FROM order_items x WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.order_id = x.order_id))
  UNION ALL
  SELECT 'transactions', (SELECT COUNT(*) FROM transactions),
         (SELECT COUNT(*) FROM transactions x WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.order_id = x.order_id)))
SELECT table_name, CAST(rows_before AS BIGINT) AS rows_before, CAST(rows_after AS BIGINT) AS rows_after,
       CAST(rows_before - rows_after AS BIGINT) AS rows_deleted FROM c""")

_KEPT = f"""order_id NOT IN (SELECT order_id FROM shop_orders WHERE status IN ('COMPLETED', 'DELIVERED')
                                     AND order_date < {_ts_minus_days(90)})"""

ORACLE["purged_orders"] = _q(["shop_orders"], f"""
SELECT order_id, customer_id, status, total_amount FROM shop_orders WHERE {_KEPT}""")

ORACLE["purged_items"] = _q(["shop_orders", "order_items"], f"""
SELECT order_id, product_id, quantity, unit_price, subtotal FROM order_items WHERE {_KEPT}""")

ORACLE["purged_transactions"] = _q(["shop_orders", "transactions"], f"""
SELECT transaction_id, order_id, amount, status FROM transactions WHERE {_KEPT}""")

ORACLE["end_idle_sessions"] = _q(["session_data"], f"""
SELECT session_id, customer_id,
  CASE WHEN is_active = 1 AND last_activity < {STS} - INTERVAL 12 HOUR THEN 0 ELSE is_active END AS is_active
FROM session_data""")

ORACLE["create_sessions"] = _q(["session_data"], f""",
r AS (SELECT DISTINCT customer_id FROM session_data WHERE login_time >= {STS} - INTERVAL 1 DAY),
h AS (SELECT customer_id, md5(concat_ws('|', CAST(customer_id AS VARCHAR), '2024-01-31 00:00:00', '0')) AS h FROM r)
SELECT concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), substring(h, 13, 4), substring(h, 17, 4),
                 substring(h, 21, 12)) AS session_id,
       customer_id, {STS} AS login_time, {STS} AS last_activity,
       concat('192.168.', {_draw("customer_id", 0, 254)} + 1, '.', {_draw("customer_id", 1, 254)} + 1) AS ip_address,
       1 AS is_active FROM h""")

ORACLE["process_payments"] = _q(["shop_orders", "transactions"], f"""
SELECT (SELECT MAX(transaction_id) FROM transactions) + ROW_NUMBER() OVER (ORDER BY order_id) AS transaction_id,
       order_id, 'PAYMENT' AS transaction_type, CAST(50 + {_draw("order_id", 1, 450)} AS DECIMAL(12,2)) AS amount,
       ['STRIPE', 'PAYPAL', 'SQUARE'][1 + {_draw("order_id", 0, 3)}] AS payment_gateway, 'COMPLETED' AS status, 'USD' AS currency,
       {TS} AS processed_at
FROM shop_orders WHERE order_date >= {_ts_minus_days(7)}""")

# --------------------------------------------------------------------------- Q7 and aggregate-*
def _rollup_src(ts: str, known: str = "") -> str:
    return f"""SELECT CAST(order_date AS DATE) AS summary_date, COUNT(DISTINCT order_id) AS total_orders,
       SUM(total_amount) AS total_revenue FROM shop_orders
  WHERE order_date >= CAST({ts} AS DATE) - INTERVAL 7 DAY AND status IN ('COMPLETED', 'SHIPPED', 'DELIVERED'){known}
  GROUP BY CAST(order_date AS DATE)"""


ORACLE["merge_sales_summary"] = _q(["shop_orders"], f""",
src1 AS ({_rollup_src(TS_EARLY3)}),
tgt AS (SELECT ROW_NUMBER() OVER (ORDER BY summary_date NULLS FIRST) AS summary_id, summary_date, total_orders,
               total_revenue, {TS_EARLY3} AS created_at FROM src1),
src2 AS ({_rollup_src(TS)}),
kept AS (SELECT t.summary_id, t.summary_date,
           CASE WHEN s.summary_date IS NOT NULL THEN s.total_orders ELSE t.total_orders END AS total_orders,
           CASE WHEN s.summary_date IS NOT NULL THEN s.total_revenue ELSE t.total_revenue END AS total_revenue,
           t.created_at FROM tgt t LEFT JOIN src2 s ON t.summary_date = s.summary_date),
new AS (SELECT (SELECT COALESCE(MAX(summary_id), 0) FROM tgt) + ROW_NUMBER() OVER (ORDER BY s.summary_date NULLS FIRST)
               AS summary_id, s.summary_date, s.total_orders, s.total_revenue, {TS} AS created_at
        FROM src2 s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.summary_date = s.summary_date))
SELECT CAST(summary_id AS BIGINT) AS summary_id, summary_date, CAST(total_orders AS BIGINT) AS total_orders,
       CAST(total_revenue AS DECIMAL(15,2)) AS total_revenue, CAST(NULL AS BIGINT) AS total_customers,
       CAST(NULL AS DECIMAL(10,2)) AS avg_order_value, created_at
FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) u""")


# the rows of the stored table, with the rows each run inserted or changed
ORACLE["stored_sales_summary"] = f"""
WITH merged AS ({ORACLE["merge_sales_summary"]}),
early AS ({_q(["shop_orders"], _rollup_src(TS_EARLY3))}),
late AS ({_q(["shop_orders"], _rollup_src(TS))})
SELECT summary_id, summary_date, total_orders, total_revenue, (SELECT COUNT(*) FROM early) AS first_run_rows,
  (SELECT COUNT(*) FROM late l WHERE NOT EXISTS (
     SELECT 1 FROM early e WHERE e.summary_date = l.summary_date AND e.total_orders = l.total_orders
                             AND e.total_revenue IS NOT DISTINCT FROM l.total_revenue)) AS second_run_rows
FROM merged"""


ORACLE["merge_changes"] = _q(["shop_orders"], f""",
src1 AS ({_rollup_src(TS_EARLY3, f" AND order_date < {TS_EARLY3}")}),
tgt AS (SELECT ROW_NUMBER() OVER (ORDER BY summary_date) AS summary_id, * FROM src1),
src2 AS ({_rollup_src(TS)}),
late AS (SELECT ROW_NUMBER() OVER (ORDER BY summary_date) AS nr, * FROM src2 WHERE summary_date NOT IN (SELECT summary_date FROM tgt))
SELECT 'UPDATE' AS operation, t.summary_id, t.summary_date, t.total_orders AS old_orders, s.total_orders AS new_orders,
       CAST(t.total_revenue AS DECIMAL(15,2)) AS old_revenue, CAST(s.total_revenue AS DECIMAL(15,2)) AS new_revenue
FROM tgt t JOIN src2 s USING (summary_date)
WHERE t.total_orders <> s.total_orders OR t.total_revenue IS DISTINCT FROM s.total_revenue
UNION ALL
SELECT 'INSERT', (SELECT COUNT(*) FROM tgt) + nr, summary_date, NULL, total_orders, NULL, CAST(total_revenue AS DECIMAL(15,2)) FROM late""")

ORACLE["stored_place_orders"] = f"SELECT order_id, customer_id, order_date, status, total_amount, payment_method FROM ({ORACLE['place_orders']}) p"
ORACLE["stored_place_stock"] = ORACLE["placed_stock"]

ORACLE["stored_payments"] = _q(["shop_orders"], f"""
SELECT ROW_NUMBER() OVER (ORDER BY CAST(order_date AS DATE), order_id) AS transaction_id,
       order_id, 'PAYMENT' AS transaction_type, CAST(50 + {_draw("order_id", 1, 450)} AS DECIMAL(12,2)) AS amount,
       ['STRIPE', 'PAYPAL', 'SQUARE'][1 + {_draw("order_id", 0, 3)}] AS payment_gateway, 'COMPLETED' AS status, 'USD' AS currency,
       {TS} AS processed_at
FROM shop_orders WHERE order_date >= {_ts_minus_days(7)}""")


def _purged_table(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS table_name, COUNT(*) FILTER (NOT doomed) AS rows_after, COUNT(DISTINCT m) AS partitions_before,
       COUNT(DISTINCT m) FILTER (NOT doomed) AS partitions_after,
       COUNT(DISTINCT m) FILTER (m IN (SELECT m FROM o WHERE doomed)) AS partitions_replaced FROM {rows}"""


ORACLE["stored_purge"] = _q(["shop_orders", "order_items", "transactions"], f""",
o AS (SELECT order_id, strftime(order_date, '%Y-%m') AS m,
             status IN ('COMPLETED', 'DELIVERED') AND order_date < {_ts_minus_days(90)} AS doomed FROM shop_orders)
{_purged_table("orders", "o")} UNION ALL
{_purged_table("order_items", "(SELECT o.* FROM order_items JOIN o USING (order_id)) x")} UNION ALL
{_purged_table("transactions", "(SELECT o.* FROM transactions JOIN o USING (order_id)) x")}""")

ORACLE["sketched_customers"] = _q(["shop_orders"], """
SELECT strftime(order_date, '%Y-%m') AS order_month, COUNT(*) AS orders, COUNT(DISTINCT customer_id) AS exact_customers,
       true AS within_bound FROM shop_orders GROUP BY 1""")

ORACLE["streamed_sales_summary"] = _q(["shop_orders"], """
SELECT CAST(order_date AS DATE) AS summary_date, COUNT(*) AS total_orders, CAST(SUM(total_amount) AS DECIMAL(15,2)) AS total_revenue
FROM shop_orders WHERE status IN ('COMPLETED', 'SHIPPED', 'DELIVERED') GROUP BY 1""")


def _cust_stats(ts: str) -> str:
    return f"""SELECT customer_id, COUNT(*) AS total_orders, CAST(SUM(total_amount) AS DECIMAL(12,2)) AS total_spent,
    CAST({_hu('SUM(total_amount)', 'COUNT(total_amount)')} AS DECIMAL(10,2)) AS avg_order_value,
    MAX(order_date) AS last_order_date,
    CASE WHEN SUM(total_amount) >= 1000 THEN 'HIGH_VALUE' WHEN SUM(total_amount) >= 500 THEN 'MEDIUM_VALUE'
         ELSE 'LOW_VALUE' END AS customer_segment, {ts} AS calculated_at
  FROM shop_orders WHERE order_date <= {ts} GROUP BY customer_id"""


_ST_COLS = ["total_orders", "total_spent", "avg_order_value", "last_order_date", "customer_segment", "calculated_at"]

ORACLE["aggregate_customers"] = _q(["shop_orders"], f""",
st1 AS ({_cust_stats(TS_EARLY30)}),
tgt AS (SELECT ROW_NUMBER() OVER (ORDER BY customer_id NULLS FIRST) AS analytics_id, * FROM st1),
st2 AS ({_cust_stats(TS)}),
kept AS (SELECT t.analytics_id, t.customer_id,
  {", ".join(f"CASE WHEN s.customer_id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in _ST_COLS)}
  FROM tgt t LEFT JOIN st2 s ON t.customer_id = s.customer_id),
new AS (SELECT (SELECT COALESCE(MAX(analytics_id), 0) FROM tgt) + ROW_NUMBER() OVER (ORDER BY s.customer_id NULLS FIRST)
          AS analytics_id, s.customer_id, {", ".join("s." + c for c in _ST_COLS)}
        FROM st2 s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.customer_id = s.customer_id))
SELECT CAST(analytics_id AS BIGINT) AS analytics_id, customer_id, total_orders, total_spent, avg_order_value,
       last_order_date, customer_segment, calculated_at
FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) u""")

_PS, _PE, _STALE = "DATE '2001-05-03'", "DATE '2001-08-01'", "TIMESTAMP '2001-07-02 00:00:00'"


def _prod_stats(hi: str) -> str:
    return f"""SELECT oi.product_id, {_PS} AS period_start, {_PE} AS period_end,
    CAST(SUM(oi.quantity) AS BIGINT) AS units_sold, CAST(SUM(oi.subtotal) AS DECIMAL(12,2)) AS revenue,
    CAST(SUM(oi.subtotal) - SUM(oi.quantity) * p.cost AS DECIMAL(12,2)) AS profit,
    CAST(COUNT(*) FILTER (WHERE o.status = 'RETURNED') AS BIGINT) AS return_count, {TS} AS calculated_at
  FROM order_items oi JOIN shop_orders o ON oi.order_id = o.order_id JOIN products p ON oi.product_id = p.product_id
  WHERE o.order_date >= {_PS} AND o.order_date < {hi}
  GROUP BY oi.product_id, p.cost"""


_PP_COLS = ["period_end", "units_sold", "revenue", "profit", "return_count", "calculated_at"]

ORACLE["aggregate_products"] = _q(["shop_orders", "order_items", "products"], f""",
st1 AS ({_prod_stats(_STALE)}),
tgt AS (SELECT ROW_NUMBER() OVER (ORDER BY product_id NULLS FIRST, period_start NULLS FIRST) AS performance_id, *
        FROM st1),
st2 AS ({_prod_stats(_PE + " + INTERVAL 1 DAY")}),
kept AS (SELECT t.performance_id, t.product_id, t.period_start,
  {", ".join(f"CASE WHEN s.product_id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in _PP_COLS)}
  FROM tgt t LEFT JOIN st2 s ON t.product_id = s.product_id AND t.period_start = s.period_start),
new AS (SELECT (SELECT COALESCE(MAX(performance_id), 0) FROM tgt)
               + ROW_NUMBER() OVER (ORDER BY s.product_id NULLS FIRST, s.period_start NULLS FIRST) AS performance_id,
               s.product_id, s.period_start, {", ".join("s." + c for c in _PP_COLS)}
        FROM st2 s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.product_id = s.product_id
                                                           AND t.period_start = s.period_start))
SELECT CAST(performance_id AS BIGINT) AS performance_id, product_id, period_start, period_end, units_sold, revenue,
       profit, return_count, calculated_at
FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) u""")

# --------------------------------------------------------------------------- report tier
_WIN_ITEMS = """order_items oi JOIN shop_orders o ON oi.order_id = o.order_id"""

ORACLE["top_products"] = _q(["order_items", "shop_orders", "products"], f"""
SELECT p.product_id, p.product_name, p.category, CAST(SUM(oi.quantity) AS BIGINT) AS units_sold,
       CAST(SUM(oi.subtotal) AS DECIMAL(38,2)) AS revenue
FROM {_WIN_ITEMS} JOIN products p ON oi.product_id = p.product_id
WHERE o.order_date >= {_ts_minus_days(30)}
GROUP BY p.product_id, p.product_name, p.category
ORDER BY revenue DESC NULLS FIRST, p.product_id LIMIT 10""")

ORACLE["revenue_by_payment"] = _q(["shop_orders"], f"""
SELECT payment_method, COUNT(*) AS total_orders, CAST(SUM(total_amount) AS DECIMAL(38,2)) AS revenue
FROM shop_orders WHERE order_date >= {_ts_minus_days(30)} GROUP BY payment_method""")

ORACLE["customer_segmentation"] = _q(["shop_orders"], f""",
s AS (SELECT customer_id, COUNT(*) AS orders, SUM(total_amount) AS spend FROM shop_orders
      WHERE order_date >= {TS} - INTERVAL 12 MONTH GROUP BY customer_id)
SELECT CASE WHEN spend >= 1000 THEN 'HIGH_VALUE' WHEN spend >= 500 THEN 'MEDIUM_VALUE' ELSE 'LOW_VALUE' END AS segment,
       COUNT(*) AS customers, CAST(SUM(orders) AS BIGINT) AS orders, CAST(SUM(spend) AS DECIMAL(38,2)) AS spend
FROM s GROUP BY 1""")

ORACLE["customer_ltv"] = _q(["shop_orders"], f"""
SELECT customer_id, COUNT(*) AS orders, CAST(SUM(total_amount) AS DECIMAL(38,2)) AS lifetime_value,
       CAST({_hu('SUM(total_amount)', 'COUNT(total_amount)')} AS DECIMAL(38,2)) AS avg_order_value,
       MIN(order_date) AS first_order, MAX(order_date) AS last_order
FROM shop_orders GROUP BY customer_id""")

ORACLE["purchase_frequency"] = _q(["shop_orders"], f"""
SELECT customer_id, COUNT(*) AS orders,
  CAST({_hu("date_diff('day', CAST(MIN(order_date) AS DATE), CAST(MAX(order_date) AS DATE))", 'COUNT(*) - 1')}
       AS DECIMAL(38,2)) AS avg_days_between_orders
FROM shop_orders GROUP BY customer_id""")

_STOCK = "(SELECT product_id, SUM(quantity_available) AS stock FROM inventory GROUP BY product_id)"
_SOLD90 = f"""(SELECT oi.product_id, SUM(oi.quantity) AS units FROM {_WIN_ITEMS}
  WHERE o.order_date >= {_ts_minus_days(90)} GROUP BY oi.product_id)"""

ORACLE["inventory_turnover"] = _q(["inventory", "order_items", "shop_orders"], f"""
SELECT s.product_id, CAST(s.stock AS BIGINT) AS stock, CAST(COALESCE(d.units, 0) AS BIGINT) AS units_sold,
       CAST({_hu('COALESCE(d.units, 0)', 's.stock', 4)} AS DECIMAL(38,4)) AS turnover
FROM {_STOCK} s LEFT JOIN {_SOLD90} d ON s.product_id = d.product_id""")

ORACLE["slow_moving"] = _q(["inventory", "order_items", "shop_orders", "products"], f"""
SELECT p.product_id, p.product_name, CAST(s.stock AS BIGINT) AS stock, CAST(COALESCE(d.units, 0) AS BIGINT) AS units_sold
FROM products p JOIN {_STOCK} s ON p.product_id = s.product_id LEFT JOIN {_SOLD90} d ON p.product_id = d.product_id
WHERE p.is_active = 1 AND s.stock > 0 AND COALESCE(d.units, 0) < 5""")

ORACLE["profit_margin"] = _q(["order_items", "shop_orders", "products"], f""",
x AS (SELECT p.category, p.product_id, SUM(oi.subtotal) AS r, SUM(oi.quantity * p.cost) AS c
      FROM {_WIN_ITEMS} JOIN products p ON oi.product_id = p.product_id
      WHERE o.order_date >= {_ts_minus_days(90)} GROUP BY GROUPING SETS ((p.category), (p.category, p.product_id)))
SELECT category, product_id, CAST(r AS DECIMAL(38,2)) AS revenue, CAST(c AS DECIMAL(38,2)) AS cost,
       CAST(r - c AS DECIMAL(38,2)) AS profit, CAST({_hu('(r - c) * 100', 'r', 2, 2)} AS DECIMAL(38,2)) AS margin_pct
FROM x""")

ORACLE["affinity"] = _q(["order_items", "shop_orders", "products"], f""",
items AS (SELECT DISTINCT oi.order_id, oi.product_id FROM {_WIN_ITEMS} WHERE o.order_date >= {_ts_minus_days(90)}),
per AS (SELECT product_id, COUNT(*) AS orders FROM items GROUP BY product_id),
anc AS (SELECT product_id AS anchor_id, orders AS anchor_n FROM per JOIN products USING (product_id)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY category ORDER BY orders DESC, product_id) = 1),
tot AS (SELECT COUNT(DISTINCT order_id) AS n_all FROM items),
tog AS (SELECT anc.anchor_id, anc.anchor_n, i.product_id, COUNT(*) AS together
        FROM anc JOIN items a ON a.product_id = anc.anchor_id JOIN items i ON i.order_id = a.order_id
        WHERE i.product_id <> anc.anchor_id GROUP BY ALL)
SELECT t.anchor_id, t.product_id, t.together, p.orders,
       CAST({_hu('t.together * 100', 't.anchor_n')} AS DECIMAL(38,2)) AS support_pct,
       CAST({_hu('t.together * tot.n_all', 't.anchor_n * p.orders', 4)} AS DECIMAL(38,4)) AS lift
FROM tog t JOIN per p ON t.product_id = p.product_id CROSS JOIN tot""")

ORACLE["affinity_pairs"] = _q(["order_items"], f""",
items AS (SELECT DISTINCT order_id, product_id FROM order_items),
per AS (SELECT product_id, COUNT(*) AS orders FROM items GROUP BY product_id),
tot AS (SELECT COUNT(DISTINCT order_id) AS n_all FROM items),
tog AS (SELECT x.product_id AS product_a, y.product_id AS product_b, COUNT(*) AS together
        FROM items x JOIN items y ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY ALL HAVING COUNT(*) >= 2)
SELECT product_a, product_b, together, a.orders AS orders_a, b.orders AS orders_b,
       CAST({_hu('together * n_all', 'a.orders * b.orders', 4)} AS DECIMAL(38,4)) AS lift
FROM tog JOIN per a ON a.product_id = product_a JOIN per b ON b.product_id = product_b CROSS JOIN tot""")

ORACLE["revenue_growth"] = _q(["order_items", "shop_orders", "products"], f""",
x AS (SELECT p.category, year(o.order_date) * 12 + month(o.order_date) - 1 AS m, SUM(oi.subtotal) AS rev
      FROM {_WIN_ITEMS} JOIN products p ON oi.product_id = p.product_id
      WHERE o.order_date >= {TS} - INTERVAL 12 MONTH GROUP BY 1, 2),
y AS (SELECT category, m, rev,
        CASE WHEN lag(m) OVER (PARTITION BY category ORDER BY m) = m - 1
             THEN lag(rev) OVER (PARTITION BY category ORDER BY m) END AS prev FROM x)
SELECT category, strftime(make_date(CAST(m // 12 AS BIGINT), CAST(m % 12 + 1 AS BIGINT), 1), '%Y-%m') AS month,
       CAST(rev AS DECIMAL(38,2)) AS revenue, CAST(prev AS DECIMAL(38,2)) AS prev_revenue,
       CAST({_hu('(rev - prev) * 100', 'prev', 2, 2)} AS DECIMAL(38,2)) AS growth_pct
FROM y""")

ORACLE["sales_report"] = _q(["shop_orders"], f"""
SELECT CAST(order_date AS DATE) AS order_day, status, COUNT(*) AS total_orders,
       CAST(SUM(total_amount) AS DECIMAL(38,2)) AS revenue,
       CAST(GROUPING(CAST(order_date AS DATE), status) AS INTEGER) AS grouping_level
FROM shop_orders WHERE order_date >= {_ts_minus_days(30)}
GROUP BY ROLLUP (CAST(order_date AS DATE), status)""")

ORACLE["inventory_report"] = _q(["inventory"], """
SELECT warehouse_location, COUNT(*) AS inventory_rows, CAST(SUM(quantity_available) AS BIGINT) AS stock,
       CAST(SUM(quantity_reserved) AS BIGINT) AS reserved,
       COUNT(*) FILTER (WHERE quantity_available < reorder_level) AS below_reorder
FROM inventory GROUP BY warehouse_location""")

ORACLE["customer_report"] = _q(["customers"], """
SELECT customer_type, state, COUNT(*) AS customers, CAST(SUM(loyalty_points) AS BIGINT) AS loyalty_points
FROM customers GROUP BY customer_type, state""")

ORACLE["transaction_report"] = _q(["transactions"], """
SELECT payment_gateway, status, COUNT(*) AS transactions, CAST(SUM(amount) AS DECIMAL(38,2)) AS amount
FROM transactions GROUP BY payment_gateway, status""")

# Column layout of the mapped shop tables (fixture CTE name, profile name, [(column, is_timestamp)]).
_PROFILE = [
    ("customers", "customers", ["customer_id", "first_name", "last_name", "email", "customer_type", "state",
                                "loyalty_points"], set()),
    ("products", "products", ["product_id", "product_name", "category", "subcategory", "price", "cost",
                              "is_active"], set()),
    ("inventory", "inventory", ["inventory_id", "product_id", "warehouse_location", "quantity_available",
                                "quantity_reserved", "reorder_level"], set()),
    ("shop_orders", "orders", ["order_id", "customer_id", "order_date", "status", "total_amount",
                               "payment_method"], {"order_date"}),
    ("order_items", "order_items", ["order_id", "product_id", "quantity", "unit_price", "discount", "subtotal"],
     set()),
    ("transactions", "transactions", ["transaction_id", "order_id", "transaction_type", "amount",
                                      "payment_gateway", "status", "processed_at"], {"processed_at"}),
    ("session_data", "sessions", ["session_id", "customer_id", "login_time", "last_activity", "is_active"],
     {"login_time", "last_activity"}),
]


def _profile_sql() -> str:
    parts = []
    for cte, name, cols, ts_cols in _PROFILE:
        for c in cols:
            lo, hi = (f"strftime(MIN({c}), '%Y-%m-%d %H:%M:%S')", f"strftime(MAX({c}), '%Y-%m-%d %H:%M:%S')") \
                if c in ts_cols else (f"CAST(MIN({c}) AS VARCHAR)", f"CAST(MAX({c}) AS VARCHAR)")
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, "
                         f"COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, {lo} AS min_value, {hi} AS max_value "
                         f"FROM {cte}")
    return _q([p[0] for p in _PROFILE], "\n" + "\nUNION ALL\n".join(parts))


ORACLE["full_table_scan"] = _profile_sql()


def _constraint_sql(source: dict[str, str] | None = None, absent: dict[str, set] | None = None) -> str:
    """One row per declared constraint; ``source`` gives the text to read a table from, ``absent`` its missing columns."""
    from ..schema import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, UNIQUE_KEYS
    cols = {name: set(c) - (absent or {}).get(name, set()) for _, name, c, _ in _PROFILE}
    cte = {name: (source or {}).get(name, c) for c, name, _, _ in _PROFILE}
    tables = sorted(t for t in ("customers", "products", "inventory", "orders", "order_items", "transactions"))
    parts = []

    def row(kind, cname, count):
        parts.append(f"SELECT '{kind}' AS constraint_type, '{cname}' AS constraint_name, CAST({count} AS BIGINT) AS violating_rows")

    def dup(kind, cname, tb, c):
        row(kind, cname, "NULL" if c not in cols[tb] else
            f"(SELECT COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM {cte[tb]} x WHERE {c} IS NOT NULL GROUP BY {c}) d WHERE n > 1)")

    def nul(kind, cname, tb, c):
        row(kind, cname, "NULL" if c not in cols[tb] else f"(SELECT COUNT(*) FROM {cte[tb]} x WHERE {c} IS NULL)")

    for tb in tables:
        pk = PRIMARY_KEYS[tb][0]
        dup("PRIMARY_KEY", f"pk_{tb}", tb, pk)
        nul("PRIMARY_KEY_NULL", f"pk_{tb}_null", tb, pk)
        for c in UNIQUE_KEYS.get(tb, ()):
            dup("UNIQUE", f"uq_{tb}_{c}", tb, c)
        for c in NOT_NULL.get(tb, ()):
            nul("NOT_NULL", f"nn_{tb}_{c}", tb, c)
    for ct, cc, pt, pc in FOREIGN_KEYS:
        row("FOREIGN_KEY", f"fk_{ct}_{cc}", f"(SELECT COUNT(*) FROM {cte[ct]} x WHERE x.{cc} NOT IN (SELECT {pc} FROM {cte[pt]} y))")
    return _q(sorted(c for c, name, _, _ in _PROFILE if name in tables), "\n" + "\nUNION ALL\n".join(parts))


ORACLE["constraint_report"] = _constraint_sql()

ORACLE["broken_constraint_report"] = _constraint_sql({
    "customers": """(SELECT * REPLACE (CASE WHEN customer_id % 11 = 0 THEN NULL WHEN customer_id % 13 = 0 THEN 'same@example.com'
                     ELSE email END AS email) FROM customers WHERE customer_id % 7 <> 0)""",
    "products": "(SELECT * FROM products UNION ALL SELECT * FROM products WHERE product_id % 50 = 0)",
    "inventory": "(SELECT * REPLACE (CASE WHEN product_id % 17 <> 0 THEN product_id END AS product_id) FROM inventory)",
    "order_items": "(SELECT * FROM order_items WHERE product_id % 3 <> 0 OR order_id % 2 = 0)",
    "transactions": """(SELECT * REPLACE (order_id + CASE WHEN order_id % 10 = 3 THEN 100000000 ELSE 0 END AS order_id)
                        FROM transactions)"""}, {"products": {"price"}})
