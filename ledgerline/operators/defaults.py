"""U4: column DEFAULTs of the DDL applied to incoming rows.

A column that is absent from the incoming frame gets its default (or NULL);
a column that is present keeps its values, explicit NULLs included, as an
INSERT that names the column does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lit_ts
from ..schema import DEFAULTS, SCHEMAS


def default_value(table: str, col: str, as_of=None) -> Column:
    """The DDL default of ``table.col`` as a column (the job clock for timestamp defaults), else NULL."""
    v = DEFAULTS.get(table, {}).get(col)
    if v is None:
        return F.lit(None)
    if v == "NOW":
        return lit_ts(as_of) if as_of is not None else F.localtimestamp()
    return F.lit(v)


def apply_defaults(df: DataFrame, table: str, as_of=None) -> DataFrame:
    """Return ``df`` in the full layout of ``table`` with defaults for missing columns."""
    schema = SCHEMAS[table]
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else default_value(table, f.name, as_of)).cast(f.dataType).alias(f.name)
        for f in schema.fields])
