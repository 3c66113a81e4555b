"""PRIMARY KEY / UNIQUE / NOT NULL / FOREIGN KEY checks as distributed jobs.

``constraint_violations`` returns one row per offending key (duplicates are
reported once per duplicated value with its count).  ``constraint_report``
returns one row per declared constraint with the number of offending rows,
zero included.  Duplicate checks are aggregates (map-side combined);
FK checks are left-anti joins of the child's distinct keys against the
parent's keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, UNIQUE_KEYS

_COLS = ["table_name", "constraint_type", "constraint_name", "key_value", "rows"]


def _key_text(cols):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def _dups(df, table, kind, cols):
    name = f"{kind}_{table}_{'_'.join(cols)}".lower()
    nonnull = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return (df.where(nonnull).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
            .select(F.lit(table).alias("table_name"), F.lit(kind).alias("constraint_type"),
                    F.lit(name).alias("constraint_name"), _key_text(cols).alias("key_value"), "rows"))


def _nulls(df, table, col, kind="NOT_NULL"):
    return (df.where(F.col(col).isNull()).groupBy().agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") > 0)
            .select(F.lit(table).alias("table_name"), F.lit(kind).alias("constraint_type"),
                    F.lit(f"nn_{table}_{col}".lower()).alias("constraint_name"),
                    F.lit(col).alias("key_value"), "rows"))


def _orphans(child, parent, ctable, ccol, ptable, pcol):
    keys = child.where(F.col(ccol).isNotNull()).groupBy(ccol).agg(F.count(F.lit(1)).alias("rows"))
    orph = keys.join(parent.select(F.col(pcol).alias(ccol)), ccol, "left_anti")
    return orph.select(F.lit(ctable).alias("table_name"), F.lit("FOREIGN_KEY").alias("constraint_type"),
                       F.lit(f"fk_{ctable}_{ccol}".lower()).alias("constraint_name"),
                       F.col(ccol).cast("string").alias("key_value"), "rows")


def _checks(tables):
    out = []
    present = {k for k in PRIMARY_KEYS if k in tables}
    for tb in sorted(present):
        df = tables[tb]
        pk = [c for c in PRIMARY_KEYS[tb] if c in df.columns]
        if pk:
            out.append(("PRIMARY_KEY", f"pk_{tb}", _dups(df, tb, "PRIMARY_KEY", pk)))
            for c in pk:
                out.append(("PRIMARY_KEY_NULL", f"pk_{tb}_null",
                            _nulls(df, tb, c, "PRIMARY_KEY_NULL")))
        for c in [c for c in UNIQUE_KEYS.get(tb, ()) if c in df.columns]:
            out.append(("UNIQUE", f"uq_{tb}_{c}", _dups(df, tb, "UNIQUE", [c])))
        for c in [c for c in NOT_NULL.get(tb, ()) if c in df.columns]:
            out.append(("NOT_NULL", f"nn_{tb}_{c}", _nulls(df, tb, c)))
    for ct, cc, pt, pc in FOREIGN_KEYS:
        if ct in tables and pt in tables and cc in tables[ct].columns:
            out.append(("FOREIGN_KEY", f"fk_{ct}_{cc}", _orphans(tables[ct], tables[pt], ct, cc, pt, pc)))
    return out


def constraint_violations(tables: dict) -> DataFrame:
    """All offending keys.  ``tables`` maps DDL table names to DataFrames."""
    return reduce(DataFrame.unionByName, [df for _, _, df in _checks(tables)])


def constraint_report(tables: dict) -> DataFrame:
    """One row per declared constraint of the given tables: (constraint_type, constraint_name, violating_rows).

    A constraint whose column or parent table is absent is reported with a
    null count: not checked.  All NULL checks of a table share one aggregate
    (one scan per table); each duplicate check is one map-side-combined
    group-by on its key; each FK check one anti join of the child's distinct
    keys.
    """
    spark = next(iter(tables.values())).sparkSession
    parts, skipped = [], []
    for tb in sorted(k for k in PRIMARY_KEYS if k in tables):
        df = tables[tb]
        pk = list(PRIMARY_KEYS[tb])
        have_pk = all(c in df.columns for c in pk)
        wanted = [("PRIMARY_KEY_NULL", f"pk_{tb}_null", c) for c in pk[:1]]
        wanted += [("NOT_NULL", f"nn_{tb}_{c}", c) for c in NOT_NULL.get(tb, ())]
        null_checks = [w for w in wanted if w[2] in df.columns]
        skipped += [(kind, name) for kind, name, c in wanted if c not in df.columns]
        if null_checks:
            counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, (_, _, c) in enumerate(null_checks)])
            parts.append(counts.select(F.inline(F.array(*[
                F.struct(F.lit(kind).alias("constraint_type"), F.lit(name).alias("constraint_name"),
                         F.col(f"_n{i}").cast("bigint").alias("violating_rows"))
                for i, (kind, name, _) in enumerate(null_checks)]))))
        if have_pk:
            parts.append(_total(_dups(df, tb, "PRIMARY_KEY", pk), "PRIMARY_KEY", f"pk_{tb}"))
        else:
            skipped.append(("PRIMARY_KEY", f"pk_{tb}"))
        for c in UNIQUE_KEYS.get(tb, ()):
            if c in df.columns:
                parts.append(_total(_dups(df, tb, "UNIQUE", [c]), "UNIQUE", f"uq_{tb}_{c}"))
            else:
                skipped.append(("UNIQUE", f"uq_{tb}_{c}"))
    for ct, cc, pt, pc in FOREIGN_KEYS:
        if ct in tables:
            if pt in tables and cc in tables[ct].columns and pc in tables[pt].columns:
                parts.append(_total(_orphans(tables[ct], tables[pt], ct, cc, pt, pc), "FOREIGN_KEY", f"fk_{ct}_{cc}"))
            else:
                skipped.append(("FOREIGN_KEY", f"fk_{ct}_{cc}"))
    if skipped:
        parts.append(spark.createDataFrame([(k, n, None) for k, n in skipped],
                                           "constraint_type string, constraint_name string, violating_rows bigint"))
    return reduce(DataFrame.unionByName, parts)


def _total(df: DataFrame, kind: str, name: str) -> DataFrame:
    return df.groupBy().agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("violating_rows")).select(
        F.lit(kind).alias("constraint_type"), F.lit(name).alias("constraint_name"), "violating_rows")
