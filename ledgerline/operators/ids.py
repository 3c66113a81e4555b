"""Surrogate keys (the reference's sequences), assigned in a stated order.

Distributed numbering without a single-task window:
1. range-partition by the order columns into a fixed number of partitions,
   sort each partition (the sort key is made total with all remaining
   columns, so a re-run after a lost executor numbers rows the same way);
2. the position inside a partition comes from ``monotonically_increasing_id``
   (partition index in the upper bits, row position in the lower 33);
3. per-partition row counts (one row per partition) give each partition's
   offset; that small table is broadcast back.
The tagged rows are written once to the shared checkpoint folder before
counting: range bounds come from sampling, and a second evaluation of an
input whose row order is not fixed (a join output, a re-run after a lost
executor) could otherwise cut partitions differently from the counts.
Gaps never occur; ids are start, start+1, ... in the stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_LOW33 = (1 << 33) - 1


def _sortable(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.MapType, T.VariantType)) if hasattr(T, "VariantType") else \
        not isinstance(dt, T.MapType)


def assign_ids(df: DataFrame, order_cols, id_col: str = "id", start=1,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start + rank of the row in ``order_cols`` order (ties broken by all columns).

    ``start`` is an int or a Column (e.g. :func:`next_id_col`, a scalar subquery).
    """
    spark = df.sparkSession
    keys: list[Column] = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    named = {c for c in order_cols if isinstance(c, str)}
    ties = [F.col(f.name) for f in df.schema.fields if f.name not in named and _sortable(f.dataType)]
    order = keys + ties
    base = start if isinstance(start, Column) else F.lit(start)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the copy serves the sampling of range bounds and the sort: the input's plan runs once
    df = materialize(df, "ids-input")
    tagged = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_mid", F.monotonically_increasing_id()), "ids")
    tagged = (tagged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW33))))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # offsets has one row per partition: a bounded broadcast (the window above runs over as many)
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(id_col, (base + F.col("_off") + F.col("_pos")).cast("bigint")) \
        .drop("_mid", "_pid", "_pos", "_off")


def next_id(df: DataFrame, id_col: str) -> int:
    """max(id)+1 of an existing table (1 when empty): a single scalar aggregate."""
    v = df.agg(F.max(id_col)).first()[0]
    return 1 if v is None else int(v) + 1


def next_id_col(df: DataFrame, id_col: str) -> Column:
    """max(id)+1 (1 when empty) as a scalar subquery: evaluated inside the consuming plan."""
    return df.agg(F.coalesce(F.max(id_col) + 1, F.lit(1)).cast("bigint")).scalar()
