"""Column helpers for the places where the reference's SQL dialect and Spark differ.

Every helper returns a built-in Spark expression (no Python UDF), so plans stay
inside whole-stage codegen and filters on literals keep reaching the scan.
Clock arithmetic on the frozen ``as_of`` parameter happens on Python
literals: a bound such as "24 months before as_of" is a constant, and a
constant compared with a raw column is what parquet pushdown needs.
"""

from __future__ import annotations

import calendar
import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_timestamp", "add_months_sticky", "add_months_col", "day_start", "lit_ts", "lit_date",
    "concat_null_as_empty", "month_index", "month_label_from_index", "order_desc", "order_asc",
    "hash_choice", "hash_int_between",
]


def as_timestamp(as_of) -> _dt.datetime:
    """Accept 'YYYY-MM-DD[ HH:MM:SS]', date or datetime; return a naive datetime."""
    if isinstance(as_of, _dt.datetime):
        return as_of.replace(tzinfo=None)
    if isinstance(as_of, _dt.date):
        return _dt.datetime(as_of.year, as_of.month, as_of.day)
    return _dt.datetime.fromisoformat(str(as_of))


def add_months_sticky(ts, n: int) -> _dt.datetime:
    """Month arithmetic with the reference dialect's rules.

    The time of day is kept; if the start is the last day of its month, or the
    target month is shorter, the result is the last day of the target month.
    """
    ts = as_timestamp(ts)
    m = ts.year * 12 + (ts.month - 1) + n
    y, mo = divmod(m, 12)
    mo += 1
    last_src = calendar.monthrange(ts.year, ts.month)[1]
    last_dst = calendar.monthrange(y, mo)[1]
    d = last_dst if (ts.day == last_src or ts.day > last_dst) else ts.day
    return ts.replace(year=y, month=mo, day=d)


def add_months_col(c: Column, n: int) -> Column:
    """Column form of :func:`add_months_sticky` for timestamp_ntz / date columns."""
    shifted = c + F.expr(f"INTERVAL {int(n)} MONTH")
    is_last = F.to_date(c) == F.last_day(c)
    # keep the time of day when snapping to the last day of the target month
    snapped = F.to_timestamp_ntz(F.date_format(F.last_day(shifted), "yyyy-MM-dd")) + (
        c - F.to_timestamp_ntz(F.date_format(F.to_date(c), "yyyy-MM-dd")))
    return F.when(is_last, snapped).otherwise(shifted)


def day_start(ts) -> _dt.datetime:
    """Midnight of the day of ``ts`` (the reference's TRUNC on a date)."""
    ts = as_timestamp(ts)
    return _dt.datetime(ts.year, ts.month, ts.day)


def lit_ts(ts) -> Column:
    """A TIMESTAMP_NTZ literal built from text, so neither the Python process's
    zone nor the session zone is involved; it constant-folds into pushed filters."""
    return F.lit(as_timestamp(ts).isoformat(sep=" ")).cast("timestamp_ntz")


def lit_date(d) -> Column:
    """A DATE literal built from text (zone-independent)."""
    return F.lit(as_timestamp(d).date().isoformat()).cast("date")


def concat_null_as_empty(*cols) -> Column:
    """String concatenation where NULL acts as the empty string."""
    return F.concat_ws("", *[F.col(c) if isinstance(c, str) else c for c in cols])


def month_index(ts_col: Column) -> Column:
    """Months since year 0 as an int: a cheap, sortable month key."""
    return F.year(ts_col) * 12 + F.month(ts_col) - 1


def int_div(a, b) -> Column:
    """Integral division of whole numbers (``div``), exact over the full BIGINT range."""
    return F.call_function("div", a, b)


def month_label_from_index(idx: Column) -> Column:
    """'yyyy-MM' text for a :func:`month_index` value."""
    return F.date_format(F.make_date(int_div(idx, F.lit(12)).cast("int"), (idx % 12 + 1).cast("int"), F.lit(1)),
                         "yyyy-MM")


def order_desc(c) -> Column:
    """DESC with NULLs first, as in the reference's ORDER BY ... DESC."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def _hash32(cols, seed: int) -> Column:
    """32 bits of an MD5 digest of ``seed`` and the columns (any SQL engine can state it)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
                                                for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_choice(values: list, *cols, seed: int = 0) -> Column:
    """Repeatable pick from a fixed list, keyed by column values (replaces a random choice)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (_hash32(cols, seed) % F.lit(len(values)) + 1).cast("int"))


def hash_int_between(lo: int, hi: int, *cols, seed: int = 0) -> Column:
    """Repeatable integer in [lo, hi) keyed by column values (replaces Random.Next(lo, hi))."""
    return (_hash32(cols, seed) % F.lit(hi - lo) + F.lit(lo)).cast("bigint")
