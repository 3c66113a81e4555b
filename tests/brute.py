"""Plain forms of operators, to compare the library's with on small data."""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal


def fold_reservations(inventory, requests):
    """(inventory_id, available, reserved, accepted seqs): each request in order against each row of its product."""
    by_product = defaultdict(list)
    for r in sorted(requests.collect(), key=lambda r: r["seq"]):
        by_product[r["product_id"]].append((r["seq"], r["quantity"]))
    out = {}
    for i in inventory.collect():
        have, reserved, took = i["quantity_available"], i["quantity_reserved"] or 0, set()
        for seq, q in by_product[i["product_id"]]:
            if q <= have:
                have, reserved = have - q, reserved + q
                took.add(seq)
        out[i["inventory_id"]] = (have, reserved, took)
    return out


def order_detail(t, since, recent, moderate, limit):
    """Q1 from its description: every line of every order in the window, per warehouse and payment of it."""
    rows = {k: [r.asDict() for r in t[k].collect()] for k in ("customers", "orders", "order_items", "products", "inventory", "transactions")}
    customers = {c["customer_id"]: c for c in rows["customers"]}
    products = {p["product_id"]: p for p in rows["products"]}
    stock, paid, lines = defaultdict(list), defaultdict(list), defaultdict(list)
    for i in rows["inventory"]:
        stock[i["product_id"]].append(i)
    for x in rows["transactions"]:
        paid[x["order_id"]].append(x)
    for i in rows["order_items"]:
        lines[i["order_id"]].append(i)
    per_customer = defaultdict(list)
    for o in rows["orders"]:
        if o["order_date"] < since or o["customer_id"] not in customers:
            continue
        for i in lines[o["order_id"]]:
            if i["product_id"] in products:
                for v in stock[i["product_id"]] or [None]:
                    for x in paid[o["order_id"]] or [None]:
                        per_customer[o["customer_id"]].append((o, i, v, x))
    out = []
    last = float("inf")
    for cid in sorted(per_customer):
        mine, c = per_customer[cid], customers[cid]
        spent = [o["total_amount"] for o, *_ in mine if o["total_amount"] is not None]
        value = sum(spent, Decimal(0)) if spent else None
        dates = [o["order_date"] for o, *_ in mine]
        first_place = {}
        for k, d in enumerate(sorted(dates, reverse=True)):
            first_place.setdefault(d, k + 1)
        mine.sort(key=lambda r: (-r[0]["order_date"].timestamp(), r[1]["subtotal"] is not None, -(r[1]["subtotal"] or 0), r[0]["order_id"],
                                 r[1]["product_id"], r[1]["quantity"], r[1]["unit_price"],
                                 r[2]["inventory_id"] if r[2] else last, r[3]["transaction_id"] if r[3] else last))
        for o, i, v, x in mine:
            p = products[i["product_id"]]
            age = "RECENT" if o["order_date"] >= recent else "MODERATE" if o["order_date"] >= moderate else "OLD"
            kind = "HIGH_VALUE" if value is not None and value >= 1000 else "MEDIUM_VALUE" if value is not None and value >= 500 else "LOW_VALUE"
            out.append((cid, (c["first_name"] or "") + " " + (c["last_name"] or ""), c["email"], c["customer_type"], c["loyalty_points"],
                        len(mine), value, first_place[o["order_date"]], o["order_id"], o["order_date"], o["status"], o["total_amount"],
                        o["payment_method"], i["product_id"], p["product_name"], p["category"], i["quantity"], i["unit_price"],
                        i["subtotal"], v and v["quantity_available"], x and x["transaction_id"], x and x["status"],
                        x and x["payment_gateway"], age, kind))
        if len(out) >= limit:
            break
    return out[:limit]
