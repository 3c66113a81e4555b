"""Stored tables of which single partitions are replaced (R5, R6, U1, B14 without rewriting the table).

A partitioned table is ``<root>/<name>/version-*/part=<value>/``: a version
holds the partitions that one job wrote, and its file ``_manifest`` lists, for
every partition of the table, the version that holds its current rows.  The
pointer file beside the tables (see :mod:`.sinks`) names each table's current
version, so a job replaces partitions of one table or of several by writing
them and renaming that one file; all other partitions stay as files.

An append is a partition of its own, named after its batch: a batch that is
run again replaces itself, and its rows keep their ids.

Partition values are never null, and words of letters, digits, ``.``, ``_`` and ``-``.  The
manifest is read by the driver: one line per partition, as for any
partitioned table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ids import assign_ids
from ..operators.upsert import upsert_changes
from ..schema import SCHEMAS
from ..session import materialize
from .sinks import _fs, _pointers, _publish, read_text, write_text

PART = "part"
MANIFEST = "_manifest"
_VALUE = re.compile(r"[A-Za-z0-9._-]+")


def month_of(column: str) -> Column:
    """The usual partition of dated rows: their month (rows without a date share one)."""
    return F.coalesce(F.date_format(column, "yyyy-MM"), F.lit("none"))


def _split(path: str) -> tuple[str, str]:
    root, name = path.rstrip("/").rsplit("/", 1)
    return root, name


def manifest(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """Partition value -> (version, note) of the table's current partitions."""
    root, name = _split(path)
    tag = _pointers(spark, root).get(name)
    if not tag:
        return {}
    lines = [line.split("\t") for line in read_text(spark, f"{root}/{name}/{tag}/{MANIFEST}").split("\n") if line]
    return {value: (version, note) for value, version, note in lines}


def read_partitions(spark: SparkSession, path: str, schema: T.StructType | str, values=None, with_part: bool = False) -> DataFrame:
    """The rows of a partitioned table, or of the partitions ``values`` alone (no other file is listed or read)."""
    folders = [f"{path.rstrip('/')}/{version}/{PART}={value}" for value, (version, _) in sorted(manifest(spark, path).items())
               if values is None or value in values]
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    if with_part:
        # the partition is a folder name, not a column of the files
        name = F.regexp_extract("_metadata.file_path", f"/{PART}=([^/]+)/", 1) if folders else F.lit("")
        rows = rows.select("*", name.alias(PART))
    return rows


def touched(rows: DataFrame, part: Column) -> list[str]:
    """The partitions that rows belong to."""
    return sorted(r[0] for r in rows.select(part.alias(PART)).distinct().collect())


def replace_partitions(root: str, tables: dict[str, tuple[DataFrame, list[str]]], notes: dict[str, str] | None = None,
                       **published: str) -> None:
    """Replace partitions of tables together: name -> (rows with the column ``part``, the partitions they replace).

    Listed partitions without rows go.  ``notes`` (by partition) are kept in
    the manifests, ``published`` words in the pointer file.
    """
    if not tables:
        return
    root, tag = root.rstrip("/"), f"version-{uuid.uuid4().hex[:12]}"
    spark = next(iter(tables.values()))[0].sparkSession
    keep: dict[str, set[str]] = {}
    for name, (rows, values) in tables.items():
        bad = [v for v in values if not _VALUE.fullmatch(v)]
        if bad:
            raise ValueError(f"partition values {bad[:3]} of {name}")
        folder = f"{root}/{name}/{tag}"
        # a partition's rows in few files; AQE splits one that is large
        rows.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(folder)
        fs, p, _ = _fs(spark, folder)
        written = {s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{PART}=")}
        if written - set(values):
            raise ValueError(f"rows of {name} outside the stated partitions: {sorted(written - set(values))[:3]}")
        before = manifest(spark, f"{root}/{name}")
        after = {v: x for v, x in before.items() if v not in values} | {v: (tag, (notes or {}).get(v, "")) for v in written}
        write_text(spark, f"{folder}/{MANIFEST}", "\n".join(f"{v}\t{x}\t{n}" for v, (x, n) in sorted(after.items())))
        # running readers may still hold the partitions before
        keep[name] = {x for x, _ in [*after.values(), *before.values()]}
    _publish(spark, root, dict.fromkeys(tables, tag), published, keep)


def write_partitioned(rows: DataFrame, path: str, part: Column) -> None:
    """Store ``rows`` as a partitioned table; partitions not among them are dropped."""
    root, name = _split(path)
    values = touched(rows, part)
    replace_partitions(root, {name: (rows.withColumn(PART, part), sorted({*values, *manifest(rows.sparkSession, path)}))})


def merge_partitions(spark: SparkSession, path: str, table: str, source: DataFrame, part: Callable[[str], Column], by: str,
                     keys: list[str], update_cols: list[str], id_col: str, as_of=None, check_unique: bool = True) -> DataFrame:
    """U1 as a stored job that costs what it touches; returns the change feed (see :func:`upsert_changes`).

    ``by`` is the merge key that decides the partition, so only the source's
    partitions are read and written.  The next id is published with them.
    """
    root, name = _split(path)
    source = materialize(source, f"merge-{table}-source")
    values = touched(source, part(by))
    target = read_partitions(spark, path, SCHEMAS[table], values)
    start = int(_pointers(spark, root).get(f"{name}.next_id", 1))
    merged, changes = upsert_changes(target, source, keys, update_cols, id_col=id_col, table=table, as_of=as_of,
                                     check_unique=check_unique, start=start)
    changes = materialize(changes, f"merge-{table}-changes")
    inserted = changes.where("operation = 'INSERT'").count()
    if not changes.isEmpty():
        replace_partitions(root, {name: (merged.withColumn(PART, part(by)), values)}, **{f"{name}.next_id": str(start + inserted)})
    return changes


def append_batch(rows: DataFrame, path: str, batch: str, id_col: str | None = None, order_cols: list[str] | None = None) -> int:
    """R5, repeatable: the rows of a batch, published as its partition; run again, the batch replaces itself.

    With ``id_col`` the rows get ids after the table's last, in the order of
    ``order_cols``.  A batch run again with as many rows keeps its ids; with
    another number it takes new ones.  Returns the number of rows.
    """
    spark = rows.sparkSession
    root, name = _split(path)
    rows = materialize(rows, f"append-{name}")
    n = rows.count()
    published = {}
    note = f"{n}"
    if id_col:
        _, before = manifest(spark, path).get(batch, ("", ""))
        following = int(_pointers(spark, root).get(f"{name}.next_id", 1))
        kept = before.split(",") if before else []
        start = int(kept[1]) if len(kept) == 2 and int(kept[0]) == n else following
        rows = assign_ids(rows, order_cols or rows.columns, id_col=id_col, start=start)
        published[f"{name}.next_id"] = str(max(following, start + n))
        note = f"{n},{start}"
    replace_partitions(root, {name: (rows.withColumn(PART, F.lit(batch)), [batch])}, {batch: note}, **published)
    return n
