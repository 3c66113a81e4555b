"""Change rows in the AUDIT_LOG layout from a before/after pair of a table.

A full outer join on the key classifies each key as INSERT (after only),
DELETE (before only) or UPDATE (both, the JSON images of the non-key
columns differ); unchanged keys produce no row.  Audit ids are dense and
ordered by (record id, operation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lit_ts
from .ids import assign_ids


def audit_diff(before: DataFrame, after: DataFrame, key: str, table_name: str, changed_by: str = "ledgerline",
               as_of=None, start_id: int = 1) -> DataFrame:
    """AUDIT_LOG rows (INSERT / UPDATE / DELETE with JSON row images) between two versions of a table keyed by ``key``."""
    vals = [c for c in before.columns if c != key]
    b = before.select(F.col(key).alias("_k"), F.to_json(F.struct(*vals)).alias("old_value"))
    a = after.select(F.col(key).alias("_k"), F.to_json(F.struct(*vals)).alias("new_value"))
    j = b.join(a, "_k", "full")
    op = (F.when(F.col("old_value").isNull(), "INSERT").when(F.col("new_value").isNull(), "DELETE")
          .otherwise("UPDATE"))
    changes = j.where(F.col("old_value").isNull() | F.col("new_value").isNull() |
                      (F.col("old_value") != F.col("new_value")))
    rows = changes.select(F.lit(table_name).alias("table_name"), op.alias("operation"),
                          F.col("_k").cast("bigint").alias("record_id"), "old_value", "new_value",
                          F.lit(changed_by).alias("changed_by"),
                          (lit_ts(as_of) if as_of is not None else F.localtimestamp()).alias("changed_at"))
    out = assign_ids(rows, ["record_id", "operation"], id_col="audit_id", start=start_id)
    return out.select("audit_id", "table_name", "operation", "record_id", "old_value", "new_value",
                      "changed_by", "changed_at")


def audit_changes(changes: DataFrame, key: str, table_name: str, changed_by: str = "ledgerline", as_of=None,
                  start_id: int = 1) -> DataFrame:
    """AUDIT_LOG rows of a merge's change feed (see :func:`.upsert.upsert_changes`): no second join of the table's versions."""
    vals = [f.name for f in changes.schema["new"].dataType.fields if f.name != key]
    image = lambda side: F.when(F.col(side).isNotNull(), F.to_json(F.struct(*[F.col(f"{side}.{c}").alias(c) for c in vals])))
    rows = changes.select(F.lit(table_name).alias("table_name"), "operation", F.col(f"new.{key}").cast("bigint").alias("record_id"),
                          image("old").alias("old_value"), image("new").alias("new_value"), F.lit(changed_by).alias("changed_by"),
                          (lit_ts(as_of) if as_of is not None else F.localtimestamp()).alias("changed_at"))
    return assign_ids(rows, ["record_id", "operation"], id_col="audit_id", start=start_id).select(
        "audit_id", "table_name", "operation", "record_id", "old_value", "new_value", "changed_by", "changed_at")
