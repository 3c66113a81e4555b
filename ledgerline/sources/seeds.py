"""Seed tables generated on the cluster with ``spark.range``.

``variant="setup"`` reproduces the setup script's closed forms; ``variant=
"random"`` the reset job's draws from fixed value lists, made repeatable by
hashing (seed, row number) instead of a process-local random generator.
Ids are 1..n (stable across resets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_choice, hash_int_between, lit_ts
from ..operators.defaults import apply_defaults

# The reset job's value lists, in their order.
RESET_CUSTOMER_TYPES = ["REGULAR", "PREMIUM", "VIP"]
RESET_CITIES = ["New York", "Los Angeles", "Chicago", "Houston", "Phoenix"]
RESET_STATES = ["NY", "CA", "IL", "TX", "AZ"]
RESET_CATEGORIES = ["Electronics", "Clothing", "Home & Garden", "Sports", "Books"]
RESET_SUBCATEGORIES = ["SubA", "SubB", "SubC", "SubD"]

SEED_COUNTS = {"customers": 1000, "products": 500, "inventory": 500}


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"))


def _s(c):
    return F.col(c).cast("string")


def seed_customers(spark: SparkSession, n: int = 1000, variant: str = "setup", seed: int = 42,
                   as_of=None) -> DataFrame:
    """Seed customers 1..n: the setup closed forms, or repeatable draws from the reset job's value lists."""
    r = _ids(spark, n)
    if variant == "setup":
        df = r.select(
            F.col("i").alias("customer_id"), F.concat(F.lit("FirstName"), _s("i")).alias("first_name"),
            F.concat(F.lit("LastName"), _s("i")).alias("last_name"),
            F.concat(F.lit("customer"), _s("i"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("555-"), F.lpad(_s("i"), 7, "0")).alias("phone"),
            F.concat(F.lit("City"), (F.col("i") % 50).cast("string")).alias("city"),
            F.concat(F.lit("State"), (F.col("i") % 50).cast("string")).alias("state"),
            F.lit("USA").alias("country"),
            F.when(F.col("i") % 10 == 0, "PREMIUM").otherwise("REGULAR").alias("customer_type"),
            ((F.col("i") * 100) % 10000).alias("loyalty_points"))
    else:
        df = r.select(
            F.col("i").alias("customer_id"), F.concat(F.lit("Customer"), _s("i")).alias("first_name"),
            F.concat(F.lit("Last"), _s("i")).alias("last_name"),
            F.concat(F.lit("customer"), _s("i"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("555-"), hash_int_between(1000, 9999, "i", seed=seed).cast("string")).alias("phone"),
            F.concat(hash_int_between(1, 9999, "i", seed=seed + 1).cast("string"), F.lit(" Main St")).alias("address"),
            hash_choice(RESET_CITIES, "i", seed=seed + 2).alias("city"),
            hash_choice(RESET_STATES, "i", seed=seed + 3).alias("state"),
            hash_int_between(10000, 99999, "i", seed=seed + 4).cast("string").alias("zip_code"),
            F.lit("USA").alias("country"),
            hash_choice(RESET_CUSTOMER_TYPES, "i", seed=seed + 5).alias("customer_type"),
            hash_int_between(0, 1000, "i", seed=seed + 6).alias("loyalty_points"),
            (lit_ts(as_of) if as_of is not None else F.localtimestamp()).alias("created_at"))
    return apply_defaults(df, "customers", as_of)


def seed_products(spark: SparkSession, n: int = 500, variant: str = "setup", seed: int = 42,
                  as_of=None) -> DataFrame:
    """Seed products 1..n: the setup closed forms, or repeatable draws (cost = 60 % of price)."""
    r = _ids(spark, n)
    if variant == "setup":
        i = F.col("i").cast("decimal(10,2)")
        df = r.select(
            F.col("i").alias("product_id"), F.concat(F.lit("Product "), _s("i")).alias("product_name"),
            F.concat(F.lit("Category"), (F.col("i") % 10).cast("string")).alias("category"),
            F.concat(F.lit("SubCat"), (F.col("i") % 20).cast("string")).alias("subcategory"),
            (F.lit("19.99").cast("decimal(10,2)") + i * F.lit("1.5").cast("decimal(2,1)")).alias("price"),
            (F.lit("10.00").cast("decimal(10,2)") + i * F.lit("0.75").cast("decimal(3,2)")).alias("cost"),
            F.concat(F.lit("SKU-"), F.lpad(_s("i"), 8, "0")).alias("sku"), F.lit(1).alias("is_active"))
    else:
        price = hash_int_between(10, 500, "i", seed=seed + 12).cast("decimal(10,2)")
        df = r.select(
            F.col("i").alias("product_id"), F.concat(F.lit("Product"), _s("i")).alias("product_name"),
            F.concat(F.lit("Description for Product"), _s("i")).alias("description"),
            hash_choice(RESET_CATEGORIES, "i", seed=seed + 10).alias("category"),
            hash_choice(RESET_SUBCATEGORIES, "i", seed=seed + 11).alias("subcategory"),
            price.alias("price"), (price * F.lit("0.6").cast("decimal(2,1)")).alias("cost"),
            F.lit(1).alias("is_active"),
            (lit_ts(as_of) if as_of is not None else F.localtimestamp()).alias("created_at"))
    return apply_defaults(df, "products", as_of)


def seed_inventory(spark: SparkSession, n: int = 500, variant: str = "setup", seed: int = 42,
                   as_of=None) -> DataFrame:
    """Seed one inventory row per product 1..n: the setup closed forms, or repeatable draws."""
    r = _ids(spark, n)
    if variant == "setup":
        df = r.select(F.col("i").alias("inventory_id"), F.col("i").alias("product_id"),
                      F.concat(F.lit("WH-"), (F.col("i") % 5).cast("string")).alias("warehouse_location"),
                      (F.lit(1000) + (F.col("i") * 137) % 5000).alias("quantity_available"),
                      F.lit(100).alias("reorder_level"))
    else:
        df = r.select(F.col("i").alias("inventory_id"), F.col("i").alias("product_id"),
                      hash_int_between(100, 1000, "i", seed=seed + 20).alias("quantity_available"),
                      F.lit(0).alias("quantity_reserved"),
                      hash_int_between(10, 50, "i", seed=seed + 21).alias("reorder_level"))
    return apply_defaults(df, "inventory", as_of)
