"""MERGE as a set operation (matched -> update some columns, not matched -> insert).

One full outer join of target and source, with presence flags, decides every
row: both present -> update, target only -> kept, source only -> new.  Its
result is written once, so target and source are each evaluated once; the
kept rows, the new rows and the largest id are all read from that copy.
NULL keys never match (plain equality), as in the reference.  Each
target row may match at most one source row; the reference database raises
otherwise, and so do we (``check_unique``).  New rows get surrogate ids
after the current maximum.  Columns neither updated nor inserted take the
table default (or NULL).  The same copy yields the change feed: what was
inserted or updated, with old and new images.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .defaults import default_value
from .ids import assign_ids, next_id_col


class MergeError(ValueError):
    pass


def check_unique_keys(source: DataFrame, keys: list[str]) -> None:
    """Raise when two source rows share a merge key (keys with a NULL part never match)."""
    nonnull = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    dup = source.where(nonnull).groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise MergeError(f"source has more than one row for merge key {dict(dup[0].asDict())}")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str],
           insert_cols: list[str] | None = None, id_col: str | None = None, table: str | None = None,
           as_of=None, check_unique: bool = True) -> DataFrame:
    """Return the merged table (target's columns and order); arguments as in :func:`upsert_changes`."""
    return upsert_changes(target, source, keys, update_cols, insert_cols, id_col, table, as_of, check_unique)[0]


def upsert_changes(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str],
                   insert_cols: list[str] | None = None, id_col: str | None = None, table: str | None = None,
                   as_of=None, check_unique: bool = True, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged table (target's columns and order) and its change feed.

    update_cols: columns overwritten on a match.
    insert_cols: source columns copied into new rows (default: keys + update_cols).
    id_col:      surrogate key filled for new rows from ``start`` (default: max(id)+1), in key order.
    table/as_of: used to fill DDL defaults of the other columns of new rows.

    The feed has a row for each inserted or updated row (not for a match that
    changes nothing): ``operation``, and the structs ``old`` and ``new`` with
    the target's columns (``old`` is null for an insert).
    """
    insert_cols = insert_cols or list(dict.fromkeys(keys + update_cols))
    if check_unique:  # skip only when the source is grouped by exactly the merge keys
        check_unique_keys(source, keys)
    src_cols = list(dict.fromkeys(keys + update_cols + insert_cols))
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in target.columns]).withColumn("_t", F.lit(True))
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in src_cols]).withColumn("_s", F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys])
    both = materialize(t.join(s, cond, "full_outer"), "upsert")

    matched = F.col("_s").isNotNull()
    held = both.where(F.col("_t").isNotNull())
    after = [(F.when(matched, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")) if c in update_cols else F.col(f"_t_{c}"))
             .cast(target.schema[c].dataType).alias(c) for c in target.columns]
    kept = held.select(*after)

    new_cols = []
    for f in target.schema.fields:
        c = f.name
        if c in insert_cols:
            e = F.col(f"_s_{c}")
        elif c == id_col:
            continue
        else:
            e = default_value(table, c, as_of) if table else F.lit(None)
        new_cols.append(e.cast(f.dataType).alias(c))
    new = both.where(F.col("_t").isNull()).select(*new_cols)
    if id_col:
        first = start if start is not None else next_id_col(both.select(F.col(f"_t_{id_col}").alias(id_col)), id_col)
        new = assign_ids(new, keys, id_col=id_col, start=first)
    new = new.select(*[F.col(f.name).cast(f.dataType) for f in target.schema.fields])

    before = F.struct(*[F.col(f"_t_{c}").alias(c) for c in target.columns])
    updated = held.where(matched).select(F.lit("UPDATE").alias("operation"), before.alias("old"), F.struct(*after).alias("new"))
    updated = updated.where(reduce(lambda a, b: a | b, [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in update_cols]))
    image = updated.schema["old"].dataType
    inserted = new.select(F.lit("INSERT").alias("operation"), F.lit(None).cast(image).alias("old"), F.struct(*target.columns).alias("new"))
    return kept.unionByName(new), updated.unionByName(inserted)
