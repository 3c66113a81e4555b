"""R4-R6 sinks and the table reset job.

* ``drain``: run a plan to the end without collecting (the reference only
  counts rows), through Spark's ``noop`` writer;
* ``append_table``: INSERT as a parquet append (:mod:`.partitions` has the
  repeatable form, and tables of which single partitions are replaced);
* ``replace_table`` / ``replace_tables``: write new versions of a table (of
  several) into fresh folders, then name them all in one pointer file.  A
  table is never overwritten while a plan that reads it is running, which is
  what a MERGE into the table it reads (Q7, U1) needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import SCHEMAS
from .seeds import SEED_COUNTS, seed_customers, seed_inventory, seed_products


def drain(df: DataFrame) -> None:
    """Run the plan to the end without collecting anything (the reference only counts rows)."""
    df.write.format("noop").mode("overwrite").save()


def append_table(df: DataFrame, path: str) -> None:
    """INSERT as a parquet append."""
    df.write.mode("append").parquet(current_path(df.sparkSession, path))


# A stored table is a folder with one subfolder per version; the file
# ``_current`` beside the tables names each one's current version.  Versions
# are written in full before that file is replaced (one atomic rename), so
# readers see all old or all new tables, and a job that dies in between
# leaves them as they were.  A folder that the file does not name is a plain
# parquet folder.
POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the store ("" if there is none)."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    stream = fs.create(p)
    stream.write(bytearray(text.encode()))
    stream.close()


def _pointers(spark: SparkSession, root: str) -> dict[str, str]:
    return dict(line.split("=", 1) for line in read_text(spark, f"{root}/{POINTER}").split("\n") if line)


def _publish(spark: SparkSession, root: str, tags: dict[str, str], notes: dict[str, str],
             keep: dict[str, set[str]] | None = None) -> None:
    """Name the tables' new versions; ``keep`` has, by table, the older ones that still hold current rows."""
    before = _pointers(spark, root)
    fs, draft, jvm = _fs(spark, f"{root}/{POINTER}.{uuid.uuid4().hex[:12]}")
    write_text(spark, f"{root}/{draft.getName()}", "\n".join(f"{n}={t}" for n, t in sorted({**before, **tags, **notes}.items())))
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(),
                                                        spark._jsc.hadoopConfiguration()).rename(
        draft, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), how)
    # running readers may still hold the version before; older ones go
    for name, tag in tags.items():
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")):
            old = status.getPath()
            if old.getName().startswith("version-") and old.getName() not in {
                    tag, before.get(name), *(keep or {}).get(name, ())}:
                fs.delete(old, True)


def current_path(spark: SparkSession, path: str) -> str:
    """The folder that holds the table's current rows."""
    root, name = path.rstrip("/").rsplit("/", 1)
    tag = _pointers(spark, root).get(name)
    return f"{root}/{name}/{tag}" if tag else f"{root}/{name}"


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, current_path(spark, path))
    return fs.exists(p)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as the new version of the table at ``path``."""
    root, name = path.rstrip("/").rsplit("/", 1)
    replace_tables({name: df}, root)


def note(spark: SparkSession, root: str, name: str) -> str | None:
    """A word published together with tables (see :func:`replace_tables`)."""
    return _pointers(spark, root.rstrip("/")).get(name)


def replace_tables(tables: dict[str, DataFrame], root: str, **notes: str) -> None:
    """Replace several tables together (e.g. a purge of orders, items, payments); ``notes`` are published with them."""
    if not tables:
        return
    root = root.rstrip("/")
    tag = f"version-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{tag}")
    _publish(next(iter(tables.values())).sparkSession, root, dict.fromkeys(tables, tag), notes)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The current version of a stored table, read with its DDL schema (never inferred)."""
    return spark.read.schema(SCHEMAS[table]).parquet(current_path(spark, path))


# DDL table name -> key of the table dict the plans take
PLAN_KEYS = {"customers": "customers", "products": "products", "inventory": "inventory", "orders": "orders",
             "order_items": "order_items", "transactions": "transactions", "sessions": "sessions"}


def load_shop_tables(spark: SparkSession, root: str) -> dict:
    """R1 for stored tables: ``<root>/<table>`` parquet folders read with the DDL schemas."""
    return {key: read_table(spark, f"{root.rstrip('/')}/{name}", name) for name, key in PLAN_KEYS.items()}


# The tables the reset job empties, in its order.
RESET_TRUNCATE = ["order_items", "transactions", "orders", "sessions", "audit_log", "inventory",
                  "customers", "products"]


def reset_tables(spark: SparkSession, root: str, variant: str = "random", seed: int = 42, as_of=None) -> dict:
    """Empty the eight OLTP tables, then reseed customers, products, inventory.

    Each step is attempted on its own and its outcome reported, as in the
    reference (a failing step does not stop the others).
    """
    status = {}
    for tb in RESET_TRUNCATE:
        try:
            replace_table(spark.createDataFrame([], SCHEMAS[tb]), f"{root}/{tb}")
            status[tb] = "truncated"
        except Exception as e:  # reported per step
            status[tb] = f"error: {e}"
    gens = {"customers": seed_customers, "products": seed_products, "inventory": seed_inventory}
    for tb, gen in gens.items():
        try:
            replace_table(gen(spark, SEED_COUNTS[tb], variant=variant, seed=seed, as_of=as_of), f"{root}/{tb}")
            status[tb] = "seeded"
        except Exception as e:
            status[tb] = f"error: {e}"
    return status
